"""Quality rules with a verdict per host, in DataFrame functions only.

Each document's own rules come first. Failures are then counted per host, the host's failure rates are shrunk towards
the rate of all hosts with a beta prior fitted to them, and the verdict on the host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hazardflow.llm.storage import stored

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
# A host is rejected if the shrunken rate of one of these rules passes the limit.
HOST_LIMITS = {"base_failed": 0.5, "symbol_heavy": 0.5, "line_heavy": 0.5}
_SPACES = "\t\n\x0b\x0c\r "


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _SPACES, " " * len(_SPACES)), " "), "")


def _windows(hashes: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))


def _covered(windows: Column) -> Column:
    """Words under windows that occur at least twice: equal windows are neighbours once sorted with their places."""

    def repeated(ordered: Column) -> Column:
        def twin(w: Column, i: Column) -> Column:
            before = F.when(i > 0, F.get(ordered, i - 1)["h"] == w["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(F.get(ordered, i + 1)["h"] == w["h"], F.lit(False))

        return F.array_sort(F.transform(F.filter(ordered, twin), lambda w: w["p"]))

    def union(places: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        step = lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    ordered = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("h"), i.alias("p"))))
    return union(_bound(ordered, repeated))


def repeated_words(words: Column) -> Column:
    """Number of words in ``WINDOW``-word windows found twice or more, the first occurrence included."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of_windows(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w))

    def of_hashes(h: Column) -> Column:
        return F.when(F.size(h) <= WINDOW, F.lit(0)).otherwise(_bound(_windows(h), of_windows))

    return _bound(hashes, of_hashes)


def document_measures(docs: DataFrame, text_col: str, host_col: str, columns: list[str]) -> DataFrame:
    """Counts of each whole text and the document's own verdict; ``row`` holds the wanted columns.

    A null text has no words.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(F.col("_text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dropped = lambda chars: F.char_length("_text") - F.char_length(F.translate("_text", chars, ""))
    words = _bound(words_of(F.col("_text")), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    counted = docs.select(F.struct(*columns).alias("row"), F.col(host_col).cast("string").alias("host"), text.alias("_text")).select(
        "row", "host",
        F.char_length(F.translate("_text", _SPACES, "")).cast("long").alias("word_chars"),
        dropped(SYMBOLS).cast("long").alias("n_symbols"),
        _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.split("_text", "\n")).cast("long").alias("n_lines"),
        words.alias("_w"),
    )
    measured = counted.select(
        "*", F.col("_w.n").cast("long").alias("n_words"), F.col("_w.r").cast("long").alias("n_repeat_words")
    ).drop("_w")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return measured.select(
        "*", failed.alias("base_failed"), (10 * F.col("n_symbols") > F.col("n_words")).alias("symbol_heavy"),
        (10 * F.col("n_dup_lines") > 3 * F.col("n_lines")).alias("line_heavy"),
    )


def shrunken_rates(counts: DataFrame, rule: str, prior_weight: float = 100.0) -> Column:
    """Posterior mean failure rate of each host: its failures plus a beta prior fitted to all hosts by moments.

    The prior's weight is the excess of the hosts' spread over what counting alone gives, between 1 and
    ``prior_weight``; hosts that do not differ give the largest weight. The moments are scalar subqueries over the
    host table, one row each.
    """
    rate = F.col(rule) / F.col("n")
    total = F.sum("n")
    mean = F.sum(rule) / total
    moments = counts.agg(
        mean.alias("m"),
        (F.sum(F.col("n") * rate * rate) / total - mean * mean).alias("v"),
        (F.count("*") / total).alias("inverse"),
    )
    spread = F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inverse")
    weight = F.when(spread <= 0, F.lit(prior_weight)).otherwise(
        F.least(F.lit(prior_weight), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / spread - 1))
    )
    prior = moments.select(F.struct(F.col("m"), F.coalesce(weight, F.lit(prior_weight)).alias("w")).alias("p")).scalar()
    return (F.col(rule) + prior["m"] * prior["w"]) / (F.col("n") + prior["w"])


def host_verdicts(measures: DataFrame, limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """``host, host_rejected`` and the shrunken rate of each rule, one row per host.

    The counts are written, one row per host, since the prior and the rates both need them.
    """
    counts = stored(
        measures.where("host is not null").groupBy("host").agg(
            F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in limits]
        ),
        "hosts",
    )
    rated = counts.select("host", *[shrunken_rates(counts, r).alias(f"{r}_rate") for r in limits])
    rejected = F.lit(False)
    for rule, limit in limits.items():
        rejected = rejected | (F.col(f"{rule}_rate") > limit)
    return rated.withColumn("host_rejected", rejected)


def _judged(measures: DataFrame) -> DataFrame:
    """Measures with the verdict of the host and ``kept``."""
    verdicts = host_verdicts(measures).select("host", "host_rejected")
    joined = measures.join(verdicts, "host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document with its counts, ``base_failed``, ``host_rejected`` and ``kept``.

    ``kept`` is false if the document's own rules fail or its host is rejected. Documents without a host are judged by
    their own rules. Repeated rows are judged and counted one by one; an empty table gives an empty one.
    """
    found = _judged(stored(document_measures(docs, text_col, host_col, [id_col]), "measures"))
    return found.select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), *[c for c in found.columns if c != "row"])


def kept_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows that pass, with all their columns; ids play no part.

    The texts are measured twice, for the hosts' counts and for the result, rather than written a second time.
    """
    return _judged(document_measures(docs, text_col, host_col, docs.columns)).where("kept").select("row.*")


ORACLE = r"""
WITH t AS (SELECT doc_id, source AS host, coalesce(text, '') AS s, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(s, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT r, unnest(range(1, len(w) - 6)) AS p, w FROM w WHERE len(w) >= 8),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, array_to_string(w[p:p + 7], ' ')) AS c FROM p),
q AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS b FROM g WHERE c > 1),
n AS (SELECT r, sum(least(8, coalesce(p - b, 8))) AS n FROM q GROUP BY r),
m AS (SELECT doc_id, host, len(w)::BIGINT AS n_words,
  length(regexp_replace(s, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(s, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(string_split(s, chr(10))) AS n_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN n USING (r)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  10 * n_symbols > n_words AS symbol_heavy, 10 * n_dup_lines > 3 * n_lines AS line_heavy FROM m),
c AS (SELECT host, rule, count(*) AS n, sum(failed::INT) AS k
  FROM (SELECT host, unnest(['base_failed', 'symbol_heavy', 'line_heavy']) AS rule,
    unnest([base_failed, symbol_heavy, line_heavy]) AS failed FROM f WHERE host IS NOT NULL) GROUP BY ALL),
a AS (SELECT rule, sum(k) / sum(n) AS m, sum(n * (k / n) * (k / n)) / sum(n) - (sum(k) / sum(n)) ** 2 AS v,
  count(*) / sum(n) AS inverse FROM c GROUP BY rule),
z AS (SELECT rule, m, CASE WHEN v - m * (1 - m) * inverse <= 0 THEN 100.0
  ELSE least(100.0, greatest(1.0, m * (1 - m) / (v - m * (1 - m) * inverse) - 1)) END AS w FROM a),
h AS (SELECT host, bool_or((k + m * w) / (n + w) > 0.5) AS rejected FROM c JOIN z USING (rule) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM f LEFT JOIN h USING (host)
"""
