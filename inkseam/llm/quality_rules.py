r"""Line-first quality rules in DataFrame functions only.

Each line is judged by symbol, shouting, navigation, boilerplate and punctuation rules; failing lines go, and a document
that loses more than a share of its signs, or fails the document rules (too few words, too much repetition), is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkseam.llm.common import row_key, set_aside, unused

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A document losing more than this percentage of its signs to failing lines is rejected.
MAX_LOST_PERCENT = 50
SYMBOLS = "#*$%&|<>"
BOILERPLATE = ("cookie", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy", "lorem ipsum", "click here", "sign up now", "subscribe to")
SEPARATORS = "›»·•→"
#: One to three words with no closing sign.
FRAGMENT = r"^[\x20\x09-\x0D]*[^\x20\x09-\x0D]+([\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,2}[\x20\x09-\x0D]*$"
CLOSED = r"[.!?:;,\x{2026}\x{3002}\x{ff01}\x{ff1f}\x{201d}\x{00bb}\"')\]][\x20\x09-\x0D]*$"
INNER = r"[.!?,;:\x{2026}\x{3002}\x{3001}\x{ff0c}]"


MADE = ("qr_n_words", "qr_word_chars", "qr_n_symbols", "qr_n_dup_lines", "qr_n_repeat_words", "qr_lost_chars", "qr_line_chars", "qr_base_failed", "qr_text", "qr_kept")
#: Columns of the steps in between.
INTERNAL = {"qr_t", "qr_w", "qr_a", "qr_l", "qr_signs", "qr_boiler", "qr_h", "qr_n", "qr_2", "qr_4", "qr_v", "qr_s", "qr_p", "qr_j", "qr_bad"}


def _sql(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _boilerplate(text: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in BOILERPLATE) + ")"


def _failing(line: str) -> str:
    """SQL for: this line fails a rule. qr_signs and qr_boiler say whether the text has any such sign or phrase at all."""
    size, left = f"char_length({line})", f"char_length(translate({line}, '{SYMBOLS}', ''))"
    return f"""(
        (qr_signs AND (10 * ({size} - {left}) > {size}
            OR 10 * ({size} - char_length(replace({line}, '!!', ''))) > {size}
            OR ({size} - char_length(translate({line}, '{SEPARATORS}', ''))) >= 3))
        OR ({line} RLIKE {_sql(FRAGMENT)} AND NOT {line} RLIKE {_sql(CLOSED)})
        OR (qr_boiler AND {_boilerplate(f"lower({line})")})
        OR ({size} > 200 AND NOT {line} RLIKE {_sql(INNER)}))"""


def _paired(array: str, step: int) -> str:
    """SQL for the hashes of each element with the one `step` places on."""
    n = f"greatest(size({array}) - {step}, 0)"
    return f"zip_with(slice({array}, 1, {n}), slice({array}, {step + 1}, {n}), (a, b) -> xxhash64(a, b))"


def judge(docs: DataFrame) -> DataFrame:
    r"""All columns of docs plus qr_n_words, qr_word_chars, qr_n_symbols, qr_n_dup_lines, qr_n_repeat_words, qr_lost_chars,
    qr_line_chars, qr_base_failed, qr_kept and qr_text (the lines that pass).

    A null or empty text has no words and is rejected; qr_text is null for a null text. Blank lines count for nothing and
    stay. Rows are judged one by one, in one scan without shuffles: repeated rows and ids get equal results, an empty table
    gives an empty one. Very long texts are judged whole, in memory of a few times their size. Columns of docs with these
    ten names are replaced, all others stay, whatever they are called. Windows are compared by a 64-bit hash within one
    document.
    """
    docs, own = set_aside(docs.drop(*MADE), INTERNAL)
    names = list(own)
    word = r"'[\\x20\\x09-\\x0D]+'"
    # each step names its predecessor's columns more than once, so that the optimizer keeps them apart
    df = docs.withColumn("qr_t", F.expr("coalesce(text, '')"))
    common = r"split(replace(qr_t, '\n', ' '), ' ')"  # one literal sign: split without a regular expression
    df = df.select(
        "*",
        F.expr(rf"filter(CASE WHEN qr_t RLIKE '[\\t\\x0B\\f\\r]' THEN split(qr_t, {word}) ELSE {common} END, w -> w != '')").alias("qr_w"),
        F.expr(r"transform(split(qr_t, '\n'), l -> struct(l AS l, l RLIKE '[^\\x20\\x09-\\x0D]' AS full))").alias("qr_a"),
        F.expr(f"qr_t RLIKE '[{SYMBOLS}!{SEPARATORS}]'").alias("qr_signs"),
        F.expr(_boilerplate("lower(qr_t)")).alias("qr_boiler"),
    )
    df = df.select("*", F.expr("transform(filter(qr_a, a -> a.full), a -> a.l)").alias("qr_l"))
    df = df.select("*", F.expr("transform(qr_w, w -> xxhash64(w))").alias("qr_h"), F.expr("size(qr_w)").alias("qr_n"))
    df = df.select("*", F.expr(_paired("qr_h", 1)).alias("qr_2"))
    df = df.select("*", F.expr(_paired("qr_2", 2)).alias("qr_4"))
    # no sequence of four words twice: no window of eight twice
    df = df.select("*", F.expr(f"CASE WHEN size(array_distinct(qr_4)) < size(qr_4) THEN {_paired('qr_4', 4)} ELSE array() END").alias("qr_v"))
    df = df.select("*", F.expr("CASE WHEN size(array_distinct(qr_v)) < size(qr_v) THEN array_sort(transform(qr_v, (h, i) -> struct(h AS h, i AS i))) ELSE array() END").alias("qr_s"))
    df = df.select("*", F.expr("array_sort(transform(filter(qr_s, (s, k) -> (k > 0 AND qr_s[greatest(k - 1, 0)].h = s.h) OR (k < size(qr_s) - 1 AND qr_s[least(k + 1, size(qr_s) - 1)].h = s.h)), s -> s.i))").alias("qr_p"))
    df = df.select(
        *names,
        "qr_l",
        "qr_signs",
        "qr_boiler",
        F.expr("CAST(qr_n AS BIGINT)").alias("qr_n_words"),
        F.expr("CAST(char_length(array_join(qr_w, '')) AS BIGINT)").alias("qr_word_chars"),
        F.expr(f"CAST(CASE WHEN qr_signs THEN char_length(qr_t) - char_length(translate(qr_t, '{SYMBOLS}', '')) ELSE 0 END AS BIGINT)").alias("qr_n_symbols"),
        F.expr("CAST(size(qr_l) - size(array_distinct(qr_l)) AS BIGINT)").alias("qr_n_dup_lines"),
        F.expr(f"CAST(aggregate(qr_p, struct(0 AS n, -{WINDOW} AS last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) AS n, p AS last), a -> a.n) AS BIGINT)").alias("qr_n_repeat_words"),
        F.expr(f"transform(qr_a, a -> struct(a.l AS l, a.full AND {_failing('a.l')} AS bad))").alias("qr_j"),
    )
    df = df.select("*", F.expr("transform(filter(qr_j, j -> j.bad), j -> j.l)").alias("qr_bad"))
    total = "aggregate({}, 0L, (a, l) -> a + char_length(l))"
    return df.select(
        *names, "qr_n_words", "qr_word_chars", "qr_n_symbols", "qr_n_dup_lines", "qr_n_repeat_words",
        F.expr(total.format("qr_bad")).alias("qr_lost_chars"), F.expr(total.format("qr_l")).alias("qr_line_chars"),
        F.expr(f"qr_n_words < {MIN_WORDS} OR 100 * qr_n_repeat_words > {MAX_REPEAT_PERCENT} * qr_n_words").alias("qr_base_failed"),
        F.expr(r"CASE WHEN size(qr_bad) = 0 THEN text ELSE array_join(transform(filter(qr_j, j -> NOT j.bad), j -> j.l), '\n') END").alias("qr_text"),
    ).toDF(*own.values(), *MADE[:-1]).withColumn("qr_kept", F.expr(f"NOT qr_base_failed AND 100 * qr_lost_chars <= {MAX_LOST_PERCENT} * qr_line_chars"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that pass, without their failing lines; n_chars follows the text where it changed."""
    # the row number is not deterministic, so the filter stays where it is: pushed down, it would hold every step's
    # expression in itself, each as often as the next one names it
    fence = unused(docs, "qr_row")
    out = judge(docs).withColumn(fence, row_key()).where(f"qr_kept AND `{fence}` >= 0")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.expr("CASE WHEN qr_lost_chars > 0 THEN CAST(char_length(qr_text) AS BIGINT) ELSE n_chars END"))
    return out.withColumn("text", F.col("qr_text")).select(*docs.columns)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).selectExpr("doc_id", "qr_n_words AS n_words", "qr_word_chars AS word_chars", "qr_n_symbols AS n_symbols", "qr_n_dup_lines AS n_dup_lines", "qr_n_repeat_words AS n_repeat_words", "qr_base_failed AS base_failed", "qr_kept AS kept")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _oracle() -> str:
    space = r"\x20\x09-\x0D"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^{space}]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{space}]')) AS l FROM d),
win AS (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS win FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(generate_series(i, i + 7)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM win) WHERE c > 1) GROUP BY rid),
lines AS (SELECT rid, unnest(l) AS l FROM w),
lost AS (SELECT rid, sum(length(l)) AS total, sum(CASE WHEN 10 * (length(l) - length(translate(l, '{SYMBOLS}', ''))) > length(l)
    OR 10 * (length(l) - length(replace(l, '!!', ''))) > length(l) OR length(l) - length(translate(l, '{SEPARATORS}', '')) >= 3
    OR (regexp_matches(l, {_quoted(FRAGMENT)}) AND NOT regexp_matches(l, {_quoted(CLOSED)}))
    OR {_boilerplate("lower(l)")} OR (length(l) > 200 AND NOT regexp_matches(l, {_quoted(INNER)}))
    THEN length(l) ELSE 0 END) AS lost FROM lines GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(total, 0) AS total
    FROM w LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * lost <= {MAX_LOST_PERCENT} * total AS kept FROM b
"""


ORACLE = _oracle()
