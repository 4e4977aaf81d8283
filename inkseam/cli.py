"""Command line: index, search, eval, bench, serve.

    python -m inkseam.cli index --corpus C --out DIR [--store-text]
    python -m inkseam.cli search (--corpus C | --index DIR) [--algo A] [--k K] words...
    python -m inkseam.cli eval --dataset DIR | --index DIR --queries Q --qrels R [--run OUT]
    python -m inkseam.cli bench --index DIR --queries Q
    python -m inkseam.cli serve --index DIR [--addr HOST:PORT]
"""

from __future__ import annotations

import argparse
import json
import threading
import time
from concurrent.futures import ThreadPoolExecutor
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession

from inkseam.operators import evaluate, index
from inkseam.plans import retrieval
from inkseam.sources import corpus

MAX_QUERY_BYTES, MAX_K = 1000, 1000


def whole_numbers(text: str) -> list[int]:
    """Comma-separated positive integers."""
    out = [int(x) if x.isascii() and x.isdigit() else 0 for x in text.split(",")]
    if not all(out):
        raise argparse.ArgumentTypeError(f"not positive integers: {text!r}")
    return out


def algorithm_list(text: str) -> list[str]:
    names = text.split(",")
    if len(set(names)) < len(names):
        raise argparse.ArgumentTypeError("an algorithm stands twice")
    for n in names:
        retrieval.check_algorithm(n)
    return names


def parse_search(raw: str) -> tuple[str, int, str]:
    """(query, k, algorithm) of a request's query string."""
    given = parse_qs(raw, keep_blank_values=True)
    for name in ("q", "k", "algo"):
        if len(given.get(name, ())) > 1:
            raise ValueError(f"{name} may stand only once")
    if "q" not in given:
        raise ValueError("q is missing")
    q, k, algo = given["q"][0], given.get("k", ["10"])[0], given.get("algo", ["bmw"])[0]
    if not q.strip():
        raise ValueError("q is blank")
    if len(q.encode()) > MAX_QUERY_BYTES:
        raise ValueError(f"q has more than {MAX_QUERY_BYTES} bytes")
    if not (k.isascii() and k.isdigit() and 1 <= int(k) <= MAX_K):
        raise ValueError(f"k is no integer from 1 to {MAX_K}")
    retrieval.check_algorithm(algo)
    return q, int(k), algo


def _open(spark: SparkSession, args: argparse.Namespace) -> index.Index:
    if bool(args.index) == bool(getattr(args, "corpus", None)):
        raise SystemExit("give either --corpus or --index")
    return index.open_index(spark, args.index) if args.index else index.build(corpus.read_corpus(spark, args.corpus))


def run_index(spark, args) -> None:
    began = time.time()
    index.save(index.build(corpus.read_corpus(spark, args.corpus), store_text=args.store_text), args.out)
    saved = index.open_index(spark, args.out)
    seconds = time.time() - began
    print(f"docs\t{saved.meta['n_docs']}\nterms\t{saved.terms.count()}\npostings\t{saved.postings.count()}\nseconds\t{seconds:.2f}\ndocs_per_second\t{saved.meta['n_docs'] / seconds:.0f}")


def run_search(spark, args) -> None:
    if args.k < 1:
        raise SystemExit("--k must be at least 1")
    found = retrieval.search_text(_open(spark, args), " ".join(args.words), args.k, args.algo)
    for r in found.collect():
        print(f"{r.rank}\t{r.ext_id}\t{r.score:.4f}")


def run_eval(spark, args) -> None:
    base = args.dataset
    ix = index.build(corpus.read_corpus(spark, f"{base}/corpus.jsonl")) if base else index.open_index(spark, args.index)
    qrels = corpus.read_qrels(spark, args.qrels or f"{base}/qrels/test.tsv")
    queries = evaluate.only_judged(corpus.read_queries(spark, args.queries or f"{base}/queries.jsonl"), qrels)
    ranked = retrieval.with_ids(retrieval.search(ix, retrieval.query_terms(queries), args.k, args.algo), ix)
    if args.run:
        corpus.write_run(ranked, args.run, args.algo)
        run = corpus.read_run(spark, args.run)
    else:  # scores as a saved run would hold them
        run = ranked.withColumn("score", corpus.six_decimals("score").cast("double"))
    r = evaluate.summary(run, qrels).first()
    print(f"queries\t{r.queries}\nnDCG@10\t{r.ndcg10:.4f}\nR@100\t{r.recall100:.4f}\nR@1000\t{r.recall1000:.4f}\nMRR@10\t{r.mrr10:.4f}")


def run_bench(spark, args) -> None:
    ix = index.open_index(spark, args.index)
    queries = [r.text for r in corpus.read_queries(spark, args.queries).orderBy("qid").collect()][: args.limit or None]
    print("algo\tk\tclients\tqueries\tqps\tmean_ms\tp50_ms\tp95_ms\tp99_ms")
    for algo in args.algos:
        for k in args.k:
            for clients in args.clients:

                def one(text: str) -> int:
                    began = time.perf_counter_ns()
                    retrieval.search_text(ix, text, k, algo).collect()  # noqa: B023
                    return time.perf_counter_ns() - began

                for _ in range(args.warmup):
                    list(map(one, queries))
                began = time.perf_counter_ns()
                with ThreadPoolExecutor(clients) as pool:
                    taken = list(pool.map(one, queries))
                rows = spark.createDataFrame([(t,) for t in taken], "ns long")
                s = evaluate.latency_summary(rows, elapsed_ns=time.perf_counter_ns() - began).first()
                print(f"{algo}\t{k}\t{clients}\t{s.queries}\t{s.qps:.1f}\t{s.mean_ms:.3f}\t{s.p50_ms:.3f}\t{s.p95_ms:.3f}\t{s.p99_ms:.3f}", flush=True)


def handler(spark: SparkSession, ix: index.Index, slots: int):
    """Request handler class: /search and /healthz, GET and HEAD, JSON only; no free slot is an error at once."""
    free = threading.BoundedSemaphore(slots)

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict) -> None:
            raw = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(raw)

        def do_GET(self) -> None:
            at = urlsplit(self.path)
            if at.path == "/healthz":
                return self._send(200, {"status": "ok", "documents": ix.meta["n_docs"]})
            if at.path != "/search":
                return self._send(404, {"error": "not found"})
            try:
                q, k, algo = parse_search(at.query)
            except ValueError as e:
                return self._send(400, {"error": str(e)})
            if not free.acquire(blocking=False):
                return self._send(503, {"error": "no free slot"})
            try:
                began = time.perf_counter()
                rows = retrieval.search_text(ix, q, k, algo).collect()
                hits = [{"rank": r.rank, "id": r.ext_id, "score": r.score} for r in rows]
                return self._send(200, {"query": q, "algo": algo, "k": k, "took_ms": round((time.perf_counter() - began) * 1e3, 3), "results": hits})
            finally:
                free.release()

        do_HEAD = do_GET

        def do_POST(self) -> None:
            self._send(405, {"error": "GET and HEAD only"})

        do_PUT = do_DELETE = do_PATCH = do_POST

        def log_message(self, *_) -> None:
            pass

    return Handler


def run_serve(spark, args) -> None:
    host, _, port = args.addr.rpartition(":")
    ix = index.open_index(spark, args.index)
    ix.postings.persist()
    with ThreadingHTTPServer((host, int(port)), handler(spark, ix, args.max_concurrent)) as server:
        server.serve_forever()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="inkseam")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name, run, *options):
        p = sub.add_parser(name)
        for flags, kw in options:
            p.add_argument(flags, **kw)
        p.set_defaults(run_command=run)

    algo = ("--algo", {"default": "bmw", "choices": retrieval.ALGORITHMS})
    command("index", run_index, ("--corpus", {"required": True}), ("--out", {"required": True}), ("--store-text", {"action": "store_true"}))
    command("search", run_search, ("--corpus", {}), ("--index", {}), algo, ("--k", {"type": int, "default": 10}), ("words", {"nargs": "+"}))
    command("eval", run_eval, ("--dataset", {}), ("--index", {}), ("--queries", {}), ("--qrels", {}), ("--run", {}), algo, ("--k", {"type": int, "default": 1000}))
    command("bench", run_bench, ("--index", {"required": True}), ("--queries", {"required": True}), ("--algos", {"type": algorithm_list, "default": list(retrieval.ALGORITHMS)}), ("--k", {"type": whole_numbers, "default": [10, 1000]}), ("--clients", {"type": whole_numbers, "default": [1, 2, 4, 8]}), ("--warmup", {"type": int, "default": 1}), ("--limit", {"type": int, "default": 0}))
    command("serve", run_serve, ("--index", {"required": True}), ("--addr", {"default": "127.0.0.1:8080"}), ("--max-concurrent", {"type": int, "default": 16}))
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run_command(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
