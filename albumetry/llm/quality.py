"""Quality rules by host: shrunken failure rates joined back to documents.

One pass measures every whole text with column expressions (arrays inside the row; nothing is exploded). Failures of
each rule are then counted per host, the rate of each host is shrunk towards the corpus by a beta prior fitted to
all hosts (method of moments, rule by rule), and hosts that break one rule too often take their documents with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from albumetry.llm.tables import SPACES, words, written

FEWEST_WORDS = 50
MOST_REPEATED = 50  # percent of words in repeated windows
HOST_RATE = 0.5  # shrunken failure rate above which a host's documents go
SYMBOLS = "#*$%&|<>"
# What breaks each rule. The first two also fail a document by itself; the others count against its host alone.
RULES = {
    "few_words": f"n_words < {FEWEST_WORDS}",
    "repeated_words": f"100 * n_repeat_words > {MOST_REPEATED} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > n_words",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
BASE = ("few_words", "repeated_words")


def _let(value: Column, body) -> Column:
    """Evaluates ``value`` once and hands it to ``body`` (a one-element array, so that no use repeats the work)."""
    return F.transform(F.array(value), body)[0]


def _covered(positions: Column) -> Column:
    """Words in windows of three that start at the given ascending positions."""
    step = F.aggregate(
        positions, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last")),
    )
    return step["n"]


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more; ``w`` is a bound array of words."""
    n = F.size(w)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def positions(h: Column) -> Column:
        tagged = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            again = F.filter(s, lambda x, i: (
                F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
            return _covered(F.sort_array(F.transform(again, lambda x: x["i"])))

        return _let(tagged, repeated)

    none = F.lit(0).cast("long")
    return F.when(n < 4, none).otherwise(
        _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(positions(h))))


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text (null: none of anything)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = _let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    return {
        "_counted": counted,
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, measures, broken rules, base_failed) of every document, written once."""
    found = measures(F.col("text"))
    rows = docs.select("doc_id", F.col(host).alias("host"), *[c.alias(k) for k, c in found.items()]).select(
        "doc_id", "host", F.col("_counted.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.col("_counted.n_repeat_words").alias("n_repeat_words"),
    )
    rows = rows.withColumns({name: F.expr(broken) for name, broken in RULES.items()})
    return written(rows.withColumn("base_failed", F.expr(" or ".join(BASE))))


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n_docs, and of each rule its shrunken failure rate) by a beta prior fitted to the hosts.

    For n documents of a host, the variance of its rate p about the corpus rate m is m(1 - m)/n of counting noise and
    grows by the correlation rho between documents of one host: m(1 - m)(1 + (n - 1) rho)/n. The sum of n(p - m)^2 over all
    hosts gives rho, what noise explains taken off: (sum / (m(1 - m)) - hosts) / (documents - hosts), held in 0 to 1. The prior's
    strength is s = 1/rho - 1 and the rate (failed + s m) / (n + s). Without spread beyond noise (rho = 0), or where no host has
    two documents to tell, every host gets m.
    """
    failed = {name: F.sum(F.col(name).cast("long")).cast("double").alias(name) for name in RULES}
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n_docs"), *failed.values()))
    n = F.col("n_docs").cast("double")
    means = hosts.agg(F.sum(n).alias("_docs"), F.count("*").cast("double").alias("_hosts"),
                      *[(F.sum(name) / F.sum(n)).alias(f"_m_{name}") for name in RULES])
    about = hosts.crossJoin(F.broadcast(means))  # one row
    spread = about.agg(*[F.first(c).alias(c) for c in means.columns], *[
        F.sum(n * F.pow(F.col(name) / n - F.col(f"_m_{name}"), 2)).alias(f"_s_{name}") for name in RULES])

    def rate(name: str) -> Column:
        m = F.col(f"_m_{name}")
        noise = m * (1 - m)
        known = (F.col("_docs") > F.col("_hosts")) & (noise > 0)
        rho = F.when(known, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(f"_s_{name}") / noise - F.col("_hosts")) / (F.col("_docs") - F.col("_hosts")))))
        strength = 1 / rho - 1
        return F.when(rho > 0, (F.col(name) + strength * m) / (n + strength)).otherwise(m)

    return hosts.crossJoin(F.broadcast(spread)).select("host", "n_docs", *[rate(name).alias(name) for name in RULES])  # one row


def judge(docs: DataFrame, host: str = "source", most: float = HOST_RATE) -> DataFrame:
    """Measures, host rate and verdict of every document; ``host_rate`` is the highest of the rules' rates.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host, host_rate and
    kept: false if base_failed or if the host breaks a rule at a shrunken rate above ``most``. Null text has no words and
    fails; documents without a host share the null host; repeated rows each count; an empty table gives no rows; other
    columns are ignored. Texts of any length are measured whole.
    """
    rows = measured(docs, host)
    hosts = written(host_rates(rows)).select(F.col("host").alias("_h"), F.greatest(*RULES).alias("host_rate"))
    return rows.join(hosts, F.col("host").eqNullSafe(F.col("_h"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host", "host_rate",
        (~F.col("base_failed") & (F.col("host_rate") <= most)).alias("kept"),
    )
