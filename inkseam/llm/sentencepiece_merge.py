"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbol pairs wait in an agenda ordered by piece score, ties by the left place; the best pair merges and its new
neighbours enter. No piece of such a vocabulary joins a sign with a following space mark (verified when the model is
opened), and no merge crosses two neighbours that no piece holds side by side, so a text falls into units that are
encoded on their own and remembered.
In each Arrow batch, every unit the agenda met for the first time is also encoded by the sentencepiece library, and
any difference raises.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkseam.llm.common import widened

MARK = "▁"
#: Units remembered by a worker; the memory of a worker is bounded by it.
REMEMBERED = 250_000
#: Units of so many signs or fewer share one vectorised agenda, longer ones have a heap each.
SHORT_UNIT = 48
UNIT = re.compile(f"{MARK}*[^\\W\\d_¹²³]+|{MARK}*(?:(?!{MARK})[\\W\\d_¹²³])+|{MARK}+")
WHOLE = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
LETTER = re.compile(r"[^\W\d_¹²³]")


class MergeModel:
    """A BPE model opened from a .model file; identity normalisation, a dummy prefix and byte fallback are required."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        rules = spec.normalizer_spec
        if spec.trainer_spec.model_type != 2:
            raise ValueError("the model is not of merge type")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or spec.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        if any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if not spec.trainer_spec.byte_fallback:
            raise ValueError("the model has no byte fallback")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [p.piece for p in spec.pieces]
        normal = [(i, p) for i, p in enumerate(spec.pieces) if p.type == 1]
        self.id_of = {p.piece: i for i, p in normal}
        #: Agenda key: lower comes first.
        self.rank = {p.piece: -p.score for _, p in normal}
        self.neighbours = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.byte_id = {int(p.piece[1:-1], 16): i for i, p in enumerate(spec.pieces) if p.type == 6}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.last_byte = max(self.byte_of)
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.id_of):
            raise ValueError("a piece crosses a space mark or a line feed")
        #: Letters and other signs part units where no piece holds both.
        mixed = any(bool(LETTER.match(a)) != bool(LETTER.match(b)) for a, b in self.neighbours if a != MARK)
        self.unit = WHOLE if mixed else UNIT

    def split(self, unit: str) -> list[str]:
        """unit cut between neighbours that no piece holds side by side: no merge can ever cross there."""
        pairs, out, since = self.neighbours, [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in pairs:
                out.append(unit[since:i])
                since = i
        return [*out, unit[since:]]

    def merge(self, unit: str) -> list[int]:
        """Ids of one unit."""
        rank, symbols = self.rank, list(unit)
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, i + 1, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, j, pair = heapq.heappop(agenda)
            if symbols[i] + symbols[j] != pair or not symbols[i] or not symbols[j]:
                continue  # one side has merged since
            symbols[i], symbols[j] = pair, ""
            after = right[j]
            right[i] = after
            if after < n:
                left[after] = i
                if (new := pair + symbols[after]) in rank:
                    heapq.heappush(agenda, (rank[new], i, after, new))
            before = left[i]
            if before >= 0 and (new := symbols[before] + pair) in rank:
                heapq.heappush(agenda, (rank[new], before, i, new))
        return self._ids(symbols)

    def _ids(self, symbols: list[str]) -> list[int]:
        ids, id_of, byte_id = [], self.id_of, self.byte_id
        for s in symbols:
            if s:
                got = id_of.get(s)
                if got is None:
                    ids += [byte_id[b] for b in s.encode()]
                else:
                    ids.append(got)
        return ids

    def surface(self, ids: list[int]) -> str:
        """The text of a unit's ids, space marks kept."""
        if min(ids) > self.last_byte:
            return "".join([self.pieces[i] for i in ids])
        raw = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
            else:
                raw += self.pieces[i].encode()
        return raw.decode("utf-8", "replace")


class Agenda:
    """Merges many short units at once: each round takes the best-scored, leftmost pair of every unit."""

    def __init__(self, model: MergeModel):
        self.model, self.n = model, len(model.pieces)
        self.table = np.arange(0x110000, dtype=np.int64) + self.n  # signs that are no piece never merge
        for piece, i in model.id_of.items():
            if len(piece) == 1:
                self.table[ord(piece)] = i
        order = {r: k for k, r in enumerate(sorted(set(model.rank.values())))}
        self.none = len(order)
        pairs = []
        for piece, i in model.id_of.items():
            for cut in range(1, len(piece)):
                a, b = model.id_of.get(piece[:cut]), model.id_of.get(piece[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32 | b, order[model.rank[piece]], i))
        pairs.sort()
        self.keys, self.ranks, self.merged = (np.array(c, np.int64) for c in zip(*pairs)) if pairs else (np.zeros(1, np.int64),) * 3

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(there, self.ranks[at], self.none), self.merged[at]

    def merge(self, units: list[str], out: dict[str, list[int]]) -> None:
        """Ids of units of at most SHORT_UNIT signs."""
        units = sorted(units, key=len)
        for start in range(0, len(units), 5_000):
            self._merge(units[start : start + 5_000], out)

    def _merge(self, units: list[str], out: dict[str, list[int]]) -> None:
        sizes = np.array([len(u) for u in units])
        wide = int(sizes.max()) + 1
        symbols = np.full((len(units), wide), -1, np.int64)
        symbols[np.arange(wide) < sizes[:, None]] = self.table[np.frombuffer("".join(units).encode("utf-32-le"), "<u4")]
        ranks, made = self._look(symbols[:, :-1], symbols[:, 1:])
        rows, columns = np.arange(len(units)), np.arange(wide)
        done = np.full_like(symbols, -1)
        while len(rows):
            best = ranks.argmin(axis=1)
            at = np.arange(len(rows))
            live = ranks[at, best] < self.none
            if not live.all():
                done[rows[~live]] = symbols[~live]
                rows, symbols, ranks, made, best = rows[live], symbols[live], ranks[live], made[live], best[live]
                at = at[: len(rows)]
                if not len(rows):
                    break
            symbols[at, best] = made[at, best]
            after = np.minimum(columns + (columns > best[:, None]), wide - 1)
            symbols = np.take_along_axis(symbols, after, 1)
            symbols[:, -1] = -1
            after = np.minimum(columns[:-1] + (columns[:-1] > best[:, None]), wide - 2)
            ranks, made = np.take_along_axis(ranks, after, 1), np.take_along_axis(made, after, 1)
            ranks[:, -1] = self.none
            for place in (best, np.maximum(best - 1, 0)):
                ranks[at, place], made[at, place] = self._look(symbols[at, place], symbols[at, np.minimum(place + 1, wide - 1)])
        byte_id, n = self.model.byte_id, self.n
        there = done >= 0
        flat, ends = done[there].tolist(), there.sum(axis=1).cumsum().tolist()
        since = 0
        for unit, end, odd in zip(units, ends, (done >= n).any(axis=1).tolist()):
            ids = flat[since:end]
            since = end
            if odd:
                ids = [x for i in ids for x in ([i] if i < n else [byte_id[b] for b in chr(i - n).encode()])]
            out[unit] = ids


class Coder:
    """Encodes and decodes batches of texts; remembers units and checks new ones against the library."""

    def __init__(self, path: str):
        self.model = MergeModel(path)
        self.agenda = Agenda(self.model)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # units that decode to another text
        self.verified = 0
        self.head, self.tail = (np.array([x], "<u4").tobytes() for x in (self.model.bos, self.model.eos))

    def units(self, text: str) -> list[str]:
        return self.model.unit.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, units: set[str]) -> None:
        """Encode units that are not known, all agendas at once, and compare them with the library."""
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        units = [u for u in units if u not in known]
        known.update((u, older[u]) for u in units if u in older)
        units = [u for u in units if u not in known]
        if not units:
            return
        parts = {u: self.model.split(u) for u in units if len(u) > SHORT_UNIT}
        made: dict[str, list[int]] = {}
        small = {u for u in units if u not in parts} | {p for ps in parts.values() for p in ps if len(p) <= SHORT_UNIT}
        if small:
            self.agenda.merge(list(small), made)
        for unit, ps in parts.items():
            made |= {p: self.model.merge(p) for p in ps if p not in made}
            made[unit] = [i for p in ps for i in made[p]]
        self._verify(units, made)
        pack = struct.Struct
        for u in units:
            known[u] = pack(f"<{len(made[u])}I").pack(*made[u])
            if (surface := self.model.surface(made[u])) != u:
                self.odd[u] = surface

    def _verify(self, units: list[str], made: dict[str, list[int]]) -> None:
        # the library puts a space mark before each text: units without one are checked behind a line feed
        sent = [u[1:] if u[0] == MARK and len(u) > 1 else "\n" + u for u in units]
        lead = [self.model.id_of[MARK], *self.model.merge("\n")]
        for unit, theirs, text in zip(units, self.model.library.encode(sent, num_threads=1), sent):
            if theirs != (made[unit] if text[0] != "\n" or unit[0] == MARK and len(unit) > 1 else lead + made[unit]):
                raise AssertionError(f"agenda and library differ on {unit!r}: {made[unit]} and {theirs}")
        self.verified += len(units)

    def code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian 32-bit integers, begin and end included, and the decoded text."""
        split = [self.units(t) for t in texts]
        self.learn({u for us in split for u in us})
        known, odd = self.known, self.odd
        out = []
        for us in split:
            decoded = "".join([odd.get(u, u) for u in us] if odd else us)
            out.append((b"".join([self.head, *map(known.__getitem__, us), self.tail]), decoded[1:].replace(MARK, " ")))
        return out


def encode(docs: DataFrame, model_path: str, ids: bool = True) -> DataFrame:
    """All columns of docs plus sp_n_tokens, sp_ids_sha256, sp_decoded_sha256, and with `ids` sp_ids and sp_decoded.

    A null text counts as empty: begin and end ids, an empty decoded text. Rows are coded one by one, so repeated rows,
    repeated ids and extra columns change nothing; an empty table gives an empty result. A very long text is coded whole,
    unit by unit, in memory in proportion to its length. Columns of docs with these names are replaced. model_path is a
    file that every node has.
    """
    made = {"sp_n_tokens": "long", "sp_ids_sha256": "string", "sp_decoded_sha256": "string"} | ({"sp_ids": T.ArrayType(T.IntegerType()), "sp_decoded": "string"} if ids else {})
    docs = docs.drop("sp_n_tokens", "sp_ids_sha256", "sp_decoded_sha256", "sp_ids", "sp_decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        was_on = gc.isenabled()
        gc.disable()  # units are strings and bytes without cycles; collecting would walk them all again and again
        try:
            coder = None
            for whole in batches:
                coder = coder or Coder(model_path)
                for start in range(0, whole.num_rows, 1000):
                    batch = whole.slice(start, 1000)
                    rows = []
                    for packed, decoded in coder.code([t or "" for t in batch.column("text").to_pylist()]):
                        sha = hashlib.sha256(decoded.encode()).hexdigest()
                        rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(), sha, *((np.frombuffer(packed, "<i4"), decoded) if ids else ())))
                    columns = [pa.array(c) if k != 3 else pa.array(c, pa.list_(pa.int32())) for k, c in enumerate(zip(*rows))]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *made])
        finally:
            if was_on:
                gc.enable()

    return docs.mapInArrow(run, widened(docs.schema, made))


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ids=False).selectExpr("doc_id", "sp_n_tokens AS n_tokens", "sp_ids_sha256 AS ids_sha256", "sp_decoded_sha256 AS decoded_sha256")
