r"""English text analysis as column expressions: Unicode words, possessives, lower case, stopwords, Porter stems.

Texts with Hebrew letters or unbroken stretches of over 255 signs need rules that a regular expression can't state; only
those rows go through an Arrow function. Terms of whole texts come from an Arrow function that remembers the stem of each token, so no row
leaves its task; with_stems() has the same rules as SQL expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tokens are matched within windows of this many signs.
LONGEST = 255
STOPWORDS = sorted("a an as at be by if in is it no of on or to and are but for not the was into such that then they this will with their there these".split(), key=lambda w: (len(w), w[::-1]))

_IDEOGRAPH = r"[\p{IsHan}\p{IsHiragana}]"
_EXTEND = r"[\p{Mn}\p{Mc}\p{Me}\p{Cf}&&[^\x{200B}]]"
_LETTER = r"[\p{L}\p{Nl}\x{24B6}-\x{24E9}&&[^\p{IsHan}\p{IsHiragana}]]"
_BOTH = r"\x{2E}\x{27}\x{2018}\x{2019}\x{2024}\x{FE52}\x{FF07}\x{FF0E}"
_MID_LETTER = rf"[{_BOTH}\x{{3A}}\x{{B7}}\x{{387}}\x{{55F}}\x{{5F4}}\x{{2027}}\x{{FE13}}\x{{FE55}}\x{{FF1A}}]"
_MID_DIGIT = rf"[{_BOTH}\x{{2C}}\x{{3B}}\x{{37E}}\x{{589}}\x{{60C}}\x{{60D}}\x{{66C}}\x{{7F8}}\x{{2044}}\x{{FE10}}\x{{FE14}}\x{{FE50}}\x{{FE54}}\x{{FF0C}}\x{{FF1B}}]"
_SYMBOL = r"[\x{A9}\x{AE}\x{2122}]"


def _word(letter: str, digit: str, connector: str, mid_letter: str, mid_digit: str, more: str, once: str) -> str:
    run = lambda base, mid: f"(?:{base}{more}){once}(?:{mid}{more}(?:{base}{more}){once})*{'+' if once == '++' else ''}"
    return f"(?:{run(letter, mid_letter)}|{run(digit, mid_digit)}|{connector}{more}){once}"


#: Java regular expression of one token; matches of connectors alone are filtered out afterwards.
TOKEN = f"{_IDEOGRAPH}{_EXTEND}*+|{_SYMBOL}(?:(?![\\x{{FE0E}}\\x{{FE0F}}]){_EXTEND})*+\\x{{FE0F}}?+|" + _word(_LETTER, r"\p{Nd}", r"\p{Pc}", _MID_LETTER, _MID_DIGIT, f"{_EXTEND}*+", "++")
#: The same for texts without signs from U+2E80 on, and for ASCII: these classes are cheaper to match.
_LOW_LETTER, _LOW_DIGIT = r"a-zA-Z\p{L}\p{Nl}\x{24B6}-\x{24E9}", r"0-9\p{Nd}"


def _low(base: str, mid: str) -> str:
    more = rf"[{base}[\p{{Mn}}\p{{Mc}}\p{{Me}}\p{{Cf}}&&[^\x{{200B}}]]]*+"
    return f"[{base}]{more}(?:{mid}{_EXTEND}*+[{base}]{more})*+"


LOW_TOKEN = f"(?:{_low(_LOW_LETTER, _MID_LETTER)}|{_low(_LOW_DIGIT, _MID_DIGIT)}|[_\\p{{Pc}}]{_EXTEND}*+)++|{_SYMBOL}(?:(?![\\x{{FE0E}}\\x{{FE0F}}]){_EXTEND})*+\\x{{FE0F}}?+"
ASCII_TOKEN = "(?:[a-zA-Z]++(?:[.':][a-zA-Z]++)*+|[0-9]++(?:[.,;'][0-9]++)*+|_)++"
_BASE = rf"[\p{{L}}\p{{Nl}}\p{{Nd}}\x{{24B6}}-\x{{24E9}}\x{{A9}}\x{{AE}}\x{{2122}}]"
#: The same for engines without possessive quantifiers and scripts, for texts without Han, kana and Hebrew.
TOKEN_RE2 = r"(?:(?:\p{L}\p{M}*)+(?:[.:'‘’·](?:\p{L}\p{M}*)+)*|(?:\p{Nd}\p{M}*)+(?:[.,;'‘’](?:\p{Nd}\p{M}*)+)*|\p{Pc})+|[©®™]"
BASE_RE2 = r"[\p{L}\p{Nd}©®™]"


def tokenize(text: Column) -> Column:
    """Raw tokens of a text; null gives an empty array."""
    text = F.coalesce(text, F.lit(""))
    all_of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    has = lambda pattern: F.regexp_like(text, F.lit(pattern))
    found = F.when(~has(r"[^\x{0}-\x{7F}]"), all_of(ASCII_TOKEN)).when(~has(r"[^\x{0}-\x{2E7F}]"), all_of(LOW_TOKEN)).otherwise(all_of(TOKEN))
    return F.filter(found, lambda t: F.regexp_like(t, F.lit(_BASE)))


def possessive(token: Column) -> Column:
    """token without a final 's, whatever its apostrophe and case."""
    return F.regexp_replace(token, "['\\x{2019}\\x{FF07}][sS]$", "")


def lowercase(token: Column) -> Column:
    """Sign by sign: dotted capital I becomes i, and a capital sigma is never final."""
    return F.lower(F.translate(token, "İΣ", "iσ"))


def is_stopword(token: Column) -> Column:
    return token.isin(STOPWORDS)


def normalize(tokens: Column) -> Column:
    """Tokens -> words before stemming."""
    return F.filter(F.transform(tokens, lambda t: lowercase(possessive(t))), lambda t: (t != "") & ~is_stopword(t))


def needs_scanner(text: Column) -> Column:
    """Whether a text needs the scanner: Hebrew letters, or a stretch that may hold a token of over 255 signs."""
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{IsHebrew}|(?<!\S)\S{256}")), F.lit(False))


# -- the scanner ---------------------------------------------------------------------------------------------------


def _kinds():
    import regex

    kind = {
        "i": regex.compile(r"[\p{Han}\p{Hiragana}]"), "l": regex.compile(r"[\p{L}\p{Nl}\u24B6-\u24E9]"), "d": regex.compile(r"\p{Nd}"),
        "p": regex.compile(r"\p{Pc}"), "e": regex.compile(r"[\p{Mn}\p{Mc}\p{Me}\p{Cf}]"), "s": regex.compile("[©®™]"),
    }
    unescape = lambda x: regex.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), x)[1:-1]
    memo: dict[str, str] = {}

    def of(c: str) -> str:
        if c not in memo:
            memo[c] = " " if c == "\u200b" else next((k for k, r in kind.items() if r.match(c)), " ")
        return memo[c]

    return of, set(unescape(_MID_LETTER)), set(unescape(_MID_DIGIT)), regex.compile(r"[\p{Hebrew}&&\p{L}]", regex.V1)


def scan(text: str, tools=None) -> list[str]:
    """Tokens of a text by the full rules, Hebrew quotes and 255-sign windows included."""
    of, mid_letter, mid_digit, hebrew = tools or _kinds()
    kinds = "".join(map(of, text))
    out, at = [], 0

    def past_marks(i: int, stop: int) -> int:
        while i < stop and kinds[i] == "e":
            i += 1
        return i

    while at < len(text):
        stop = min(len(text), at + LONGEST)
        first, keep = kinds[at], True
        end = at + 1
        if first == "i":
            end = past_marks(end, stop)
        elif first == "s":
            while end < stop and kinds[end] == "e" and text[end] not in "\ufe0e\ufe0f":
                end += 1
            end += end < stop and text[end] == "\ufe0f"
        elif first in "ldp":
            # base: the last letter, digit or connector; joined: it came over a mid sign; sealed: over a double quote
            base, joined, sealed, via, quoted, keep = "", False, False, False, False, False
            last, i = " ", at
            end = stop
            while i < stop:
                k = kinds[i]
                if k in "ldp":
                    last, base, joined, sealed, via, quoted = k, text[i], via, quoted, False, False
                    keep |= k != "p"
                elif k != "e":
                    opens = bool(base) and bool(hebrew.match(base)) and not joined
                    if opens and text[i] == "'":
                        last, base = " ", ""
                        i += 1
                        continue
                    after = past_marks(i + 1, stop)
                    follows = kinds[after] if after < stop else ""
                    quote = text[i] == '"' and opens and follows == "l" and bool(hebrew.match(text[after]))
                    if not (quote or (last == "l" == follows and not sealed and text[i] in mid_letter) or (last == "d" == follows and text[i] in mid_digit)):
                        end = i
                        break
                    via, quoted = True, quote
                    i = after
                    continue
                i += 1
        else:
            keep = False
        if keep:
            out.append(text[at:end])
        at = end
    return out


def _scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    tools = _kinds()
    for texts in batches:
        yield texts.map(lambda t: scan(t or "", tools))


def with_words(df: DataFrame, text: str = "body", out: str = "words") -> DataFrame:
    """df with the words of its text column before stemming.

    Rows are split by a filter, not by CASE, so that Python sees only those that need it.
    """
    scanner = F.pandas_udf(_scanned, "array<string>")
    slow = needs_scanner(F.col(text))
    fast = df.where(~slow).withColumn(out, normalize(tokenize(F.col(text))))
    return fast.unionByName(df.where(slow).withColumn(out, normalize(scanner(F.col(text)))))


# -- Porter ----------------------------------------------------------------------------------------------------------

_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
POSITIVE, ONCE, TWICE = f"^({_C})?{_V}{_C}", f"^({_C})?{_V}{_C}({_V})?$", f"^({_C})?{_V}{_C}{_V}{_C}"
VOWEL, SHORT = f"^({_C})?[aeiouy]", f"^{_C}[aeiouy][^aeiouwxy]$"
DOUBLE = "(" + "|".join(c * 2 for c in "zxwvtsrqpnmlkjhgfdcb") + ")$"
DOUBLE_OTHER = r"([^\x{00}-\x{7F}])\1$"
LATE_Y = f"^({_C})?({_V}{_C})*y$"
#: suffix -> replacement where the rest has a measure above 0
SECOND = {"ousness": "ous", "fulness": "ful", "iveness": "ive", "ization": "ize", "ational": "ate", "biliti": "ble", "tional": "tion", "iviti": "ive", "aliti": "al", "alism": "al", "ation": "ate", "ousli": "ous", "entli": "ent", "izer": "ize", "anci": "ance", "enci": "ence", "ator": "ate", "alli": "al", "logi": "log", "bli": "ble", "eli": "e"}
THIRD = {"iciti": "ic", "alize": "al", "ative": "", "icate": "ic", "ness": "", "ical": "ic", "ful": ""}
#: suffixes that go where the rest has a measure above 1
FOURTH = ["ement", "ible", "able", "ence", "ance", "ment", "ize", "ive", "ous", "iti", "ate", "ism", "ion", "ent", "ant", "ou", "ic", "er", "al"]


def porter_steps(spark_sql: bool = True) -> list[str]:
    """The stemmer as successive SQL expressions over column w; each step reads the w of the step before.

    The same text serves Spark and DuckDB but for the names of functions.
    """
    if spark_sql:
        like = lambda x, p: f"({x} RLIKE '{p.replace(chr(92), chr(92) * 2)}')"
        pick = lambda p: f"regexp_extract(w, '{p}', 1)"
    else:
        like = lambda x, p: f"regexp_matches({x}, '{p}')"
        pick = lambda p: f"regexp_extract(w, '{p}', 1)"
    cut = lambda n: f"left(w, length(w) - {n})"
    ends = lambda *xs: "(" + " OR ".join(f"right(w, {len(x)}) = '{x}'" for x in xs) + ")"
    double = like("w", DOUBLE)
    if spark_sql:
        double = f"({double} OR {like('w', DOUBLE_OTHER)})"
    double = f"({double} OR (right(w, 2) = 'yy' AND {like(cut(1), LATE_Y)}))"
    mapped = lambda rules, s: "CASE " + s + "".join(f" WHEN '{a}' THEN '{b}'" for a, b in rules.items()) + " END"
    second, third, fourth = (pick(f"({'|'.join(r)})$") for r in (SECOND, THIRD, FOURTH))
    rest = lambda s: f"left(w, length(w) - length({s}))"
    long_word = "length(w) > 2"
    # marks after '~': what the -ed and -ing rule has cut must still be mended
    return [
        "CASE WHEN length(w) > 2 THEN CASE WHEN left(w, 1) = 'y' THEN concat('Y', substring(w, 2)) ELSE w END ELSE concat('=', w) END",
        f"CASE WHEN left(w, 1) = '=' THEN w WHEN {ends('sses', 'ies')} THEN {cut(2)} WHEN right(w, 1) = 's' AND right(w, 2) <> 'ss' THEN {cut(1)} ELSE w END",
        f"CASE WHEN left(w, 1) = '=' THEN w WHEN {ends('eed')} THEN CASE WHEN {like(cut(3), POSITIVE)} THEN {cut(1)} ELSE w END"
        f" WHEN {ends('ed')} AND {like(cut(2), VOWEL)} THEN concat('~', {cut(2)}) WHEN {ends('ing')} AND {like(cut(3), VOWEL)} THEN concat('~', {cut(3)}) ELSE w END",
        "CASE WHEN left(w, 1) = '~' THEN CASE WHEN " + ends("at", "bl", "iz") + " THEN concat(substring(w, 2), 'e') ELSE w END ELSE w END",
        f"CASE WHEN left(w, 1) <> '~' THEN w WHEN {double.replace('(w', '(substring(w, 2)').replace(cut(1), 'substring(w, 2, length(w) - 2)')} THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN substring(w, 2) ELSE substring(w, 2, length(w) - 2) END"
        f" WHEN {like('substring(w, 2)', ONCE)} AND {like('substring(w, 2)', SHORT)} THEN concat(substring(w, 2), 'e') ELSE substring(w, 2) END",
        f"CASE WHEN left(w, 1) <> '=' AND right(w, 1) = 'y' AND {like(cut(1), VOWEL)} THEN concat({cut(1)}, 'i') ELSE w END",
        f"CASE WHEN left(w, 1) <> '=' AND {second} <> '' AND {like(rest(second), POSITIVE)} THEN concat({rest(second)}, {mapped(SECOND, second)}) ELSE w END",
        f"CASE WHEN left(w, 1) <> '=' AND {third} <> '' AND {like(rest(third), POSITIVE)} THEN concat({rest(third)}, {mapped(THIRD, third)}) ELSE w END",
        f"CASE WHEN left(w, 1) <> '=' AND {fourth} <> '' AND {like(rest(fourth), TWICE)} AND ({fourth} <> 'ion' OR right({rest(fourth)}, 1) IN ('s', 't')) THEN {rest(fourth)} ELSE w END",
        f"CASE WHEN left(w, 1) <> '=' AND right(w, 1) = 'e' AND ({like(cut(1), TWICE)} OR ({like(cut(1), ONCE)} AND NOT {like(cut(1), SHORT)})) THEN {cut(1)} ELSE w END",
        f"CASE WHEN left(w, 1) <> '=' AND right(w, 2) = 'll' AND {like('w', TWICE)} THEN {cut(1)} ELSE w END",
        "CASE left(w, 1) WHEN '=' THEN substring(w, 2) WHEN 'Y' THEN concat('y', substring(w, 2)) ELSE w END",
    ]


def with_stems(df: DataFrame, word: str = "word", out: str = "term") -> DataFrame:
    """df with the stem of its word column. Meant for distinct words: every step is a column of its own."""
    step = df.withColumn("w", F.col(word))
    for sql in porter_steps():
        step = step.withColumn("w", F.expr(sql))
    return step.withColumnRenamed("w", out)


def stemmer() -> Callable[[str], str]:
    """porter_steps() as a function of one word."""
    positive, once, twice, vowel, short, late_y = (re.compile(p).search for p in (POSITIVE, ONCE, TWICE, VOWEL, SHORT, LATE_Y))
    double = re.compile(f"{DOUBLE}|([^\\x00-\\x7F])\\2$").search
    second, third, fourth = (tuple(sorted(r, key=len, reverse=True)) for r in (SECOND, THIRD, FOURTH))

    def stem(w: str) -> str:
        if len(w) <= 2:
            return w
        if w[0] == "y":
            w = "Y" + w[1:]
        if w.endswith(("sses", "ies")):
            w = w[:-2]
        elif w[-1] == "s" and w[-2:] != "ss":
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if positive(w[:-3]) else w
        elif (n := 2 if w.endswith("ed") else 3 if w.endswith("ing") else 0) and vowel(w[:-n]):
            w = w[:-n]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif double(w) or (w.endswith("yy") and late_y(w[:-1])):
                w = w if w[-1] in "lsz" else w[:-1]
            elif once(w) and short(w):
                w += "e"
        if w[-1:] == "y" and vowel(w[:-1]):
            w = w[:-1] + "i"
        for ends, rules in ((second, SECOND), (third, THIRD)):
            if w.endswith(ends) and positive(rest := w[: -len(end := next(filter(w.endswith, ends)))]):
                w = rest + rules[end]
        if w.endswith(fourth) and twice(rest := w[: -len(end := next(filter(w.endswith, fourth)))]) and (end != "ion" or rest[-1:] in ("s", "t")):
            w = rest
        if w[-1:] == "e" and (twice(w[:-1]) or (once(w[:-1]) and not short(w[:-1]))):
            w = w[:-1]
        if w[-2:] == "ll" and twice(w):
            w = w[:-1]
        return "y" + w[1:] if w[:1] == "Y" else w

    return stem


#: Terms that a worker remembers.
REMEMBERED = 500_000
#: Signs whose classes have long been settled, so that Python and Java agree on them; texts of others are cut by Java.
_PLAIN = ((0, 0x52F), (0x2000, 0x214F))
PLAIN = "[^" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _PLAIN) + "]"


class _Memo(dict):
    """Term of a word, or of a raw token: None where tokenize() or normalize() drops it."""

    def __init__(self, tokens: bool):
        self.stem, self.tokens, self.stop = stemmer(), tokens, set(STOPWORDS)
        self.last = re.compile("['\u2019\uff07][sS]$").sub

    def __missing__(self, x: str) -> str | None:
        if len(self) >= REMEMBERED:
            self.clear()
        word = self.last("", x).replace("\u0130", "i").replace("\u03a3", "\u03c3").lower() if self.tokens else x
        got = self[x] = None if self.tokens and (not word or word in self.stop) else self.stem(word)
        return got


def _cutter() -> Callable[[str], list[str]]:
    """tokenize() of texts of plain signs, by the full rules where a token has over 255."""
    tools, classes = _kinds(), {}
    for a, b in _PLAIN:
        for c in map(chr, range(a, b + 1)):
            classes.setdefault(tools[0](c), []).append(re.escape(c))
    letter, digit, joint, mark = ("".join(classes[k]) for k in "ldpe")
    run = lambda base, mid: f"[{base}][{base}{mark}]*+(?:[{''.join(map(re.escape, sorted(mid)))}][{mark}]*+[{base}][{base}{mark}]*+)*+"
    plain = re.compile(f"(?:{run(letter, tools[1])}|{run(digit, tools[2])}|[{joint}][{mark}]*+)++|[{''.join(classes['s'])}][{mark}]*+").findall
    simple, bare = re.compile(ASCII_TOKEN).findall, re.compile(f"[{joint}{mark}]+").fullmatch

    def cut(text: str) -> list[str]:
        found = (simple if text.isascii() else plain)(text)
        if found and len(max(found, key=len)) > LONGEST:
            return scan(text, tools)
        return [x for x in found if x[0] not in JOINTS or not bare(x)]

    return cut


JOINTS = "_\u203f\u2040\u2054"
assert all(unicodedata.category(c) == "Pc" for c in JOINTS)


def _in_terms(df: DataFrame, words: str, counted: bool, text: str | None = None, slow: str | None = None) -> DataFrame:
    """df without its columns words, text and slow but with its terms in order or, counted, with dl, distinct terms and tfs.

    text: raw tokens are in words or, where that is null, cut here; slow says where by the scanner.
    """
    kept = [c for c in df.columns if c not in (words, text, slow)]
    listed = T.StructField("terms", T.ArrayType(T.StringType()))
    made = [T.StructField("dl", T.IntegerType()), listed, T.StructField("tfs", T.ArrayType(T.IntegerType()))] if counted else [listed]
    schema = T.StructType([df.schema[c] for c in kept] + made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term, cut, tools = _Memo(text is not None), text and _cutter(), text and _kinds()
        for batch in batches:
            rows = batch.column(words).to_pylist()
            if text:
                rows = [scan(t or "", tools) if s else cut(t or "") if x is None else x for x, t, s in zip(rows, batch.column(text).to_pylist(), batch.column(slow).to_pylist())]
            out, dl, tfs = [], [], []
            for tokens in rows:
                if not counted:
                    out.append([t for x in tokens or () if (t := term[x]) is not None])
                    continue
                tf: dict[str, int] = {}
                for x, c in Counter(tokens or ()).items():
                    if (t := term[x]) is not None:
                        tf[t] = tf.get(t, 0) + c
                out.append(list(tf))
                tfs.append(list(tf.values()))
                dl.append(sum(tfs[-1]))
            new = {"dl": pa.array(dl, pa.int32())} if counted else {}
            new["terms"] = pa.array(out, pa.list_(pa.string()))
            if counted:
                new["tfs"] = pa.array(tfs, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new.values()], names=[*kept, *new])

    return df.mapInArrow(run, schema)


def stemmed(df: DataFrame, words: str = "words", counted: bool = False) -> DataFrame:
    """df with the terms of its column of words in place of it: see _in_terms()."""
    return _in_terms(df, words, counted)


def with_terms(df: DataFrame, text: str = "body", counted: bool = False) -> DataFrame:
    """df with the terms of its text column in place of it, in one pass without a shuffle: see _in_terms()."""
    kept = [F.col(c) for c in df.columns if c != text]
    odd = F.coalesce(F.regexp_like(F.col(text), F.lit(PLAIN)), F.lit(False))
    judged = df.select(*kept, text, odd.alias("_odd"), (odd & needs_scanner(F.col(text))).alias("_slow"))
    cut = F.when(F.col("_odd") & ~F.col("_slow"), tokenize(F.col(text)))
    return _in_terms(judged.select(*kept, text, "_slow", cut.alias("_tokens")), "_tokens", counted, text, "_slow")
