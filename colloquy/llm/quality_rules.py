"""Quality rules with host verdicts.

Every text is measured by itself (repetition, length, symbols). Failures are then counted by host, each host's
failure rate is shrunk towards the whole corpus with an empirical beta prior, and hosts whose shrunken rate is
above a limit lose all their documents. The host table is as long as there are hosts; it is aggregated map-side
first, so a host with a third of all rows costs one row per task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import column_udf, store, without

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_HOST_RATE = 0.5
SMALL = 8 << 20  # bytes of a host table that is sent to all tasks

METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [x.split()[0] for x in METRICS.split(", ")]
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"


def repeated_words(words: list) -> int:
    """How many words lie in a 3-word window that the text holds twice or more."""
    n = len(words)
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    if n < 4 or v == n:
        return 0
    if v < 2_000_000:
        key = (a[:-2] * v + a[1:-1]) * v + a[2:]
    else:
        pair = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1]
        key = pair[:-1] * v + a[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    hit = np.zeros(n, bool)
    for found in (order[1:][same], order[:-1][same]):
        for k in range(3):
            hit[found + k] = True
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text; None has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    space = len(raw) - len(raw.translate(None, _SPACE))
    return len(words), len(text) - space, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def text_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the five metrics and base_failed; columns of those names that docs had are replaced."""
    rest = without(docs, *NAMES, "base_failed", "_m")
    ruled = docs.select(*rest, column_udf(lambda t: [dict(zip(NAMES, measure(x), strict=True)) for x in t], f"struct<{METRICS.replace(' ', ':').replace(',:', ',')}>")(F.col(text)).alias("_m"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return ruled.select(*rest, "_m.*").withColumn("base_failed", failed)


def host_verdicts(ruled: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> tuple[DataFrame, int]:
    """One row a host: _host, host_docs, host_failed, host_rate (shrunken) and host_rejected; and the table's bytes.

    The beta prior has the corpus's failure rate as mean; its strength comes from the variance of the hosts'
    rates beyond what sampling explains (method of moments). Hosts that don't differ are pooled entirely. A null
    host is a host of its own.
    """
    hosts = store(ruled.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed")), "hosts")
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    # one row of sums comes to the driver, however many hosts there are
    size = F.sum(F.coalesce(F.octet_length(F.col("_host").cast("string")), F.lit(0)) + 64)
    s = hosts.agg(F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(f).alias("f"), F.sum(n * n).alias("nn"), F.sum(f * f / n).alias("ff"), size.alias("bytes")).first()
    strength, mean = beta_prior(s["k"], s["n"] or 0.0, s["f"] or 0.0, s["nn"] or 0.0, s["ff"] or 0.0)
    rate = (f + F.lit(strength * mean)) / (n + F.lit(strength))
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", F.col("host_rate") > max_rate), s["bytes"] or 0


#: Strengths outside these are the ends: hosts alike, or each on its own.
STRENGTHS = (1.0, 1e6)


def beta_prior(k: int, n: float, f: float, nn: float, ff: float) -> tuple[float, float]:
    """(a + b, a / (a + b)) from sums over hosts: their number, n, f, n*n and f*f/n."""
    if not n:
        return STRENGTHS[1], 0.0
    mean = f / n
    noise = mean * (1 - mean)
    room = n - nn / n
    if k < 2 or noise <= 0 or room <= 0:
        return STRENGTHS[1], mean
    # weighted ANOVA estimate of the variance between hosts
    between = (ff - f * f / n - (k - 1) * noise) / room
    return (min(max(noise / between - 1, STRENGTHS[0]), STRENGTHS[1]) if between > 0 else STRENGTHS[1]), mean


def judge(ruled: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """ruled with host_rate and kept: false where the text or its host failed."""
    verdicts, size = host_verdicts(ruled, host, max_rate)
    verdicts = verdicts.select("_host", F.col("host_rate").alias("_rate"), "host_rejected")
    rest = without(ruled, "host_rate", "kept", "_host", "_rate", "host_rejected")
    # one row a host on the right: broadcast if it is small; if not, adaptive execution splits hot hosts
    verdicts = F.broadcast(verdicts) if size <= SMALL else verdicts
    joined = ruled.select(*rest).join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left")
    return joined.select(*rest, F.col("_rate").alias("host_rate"), (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs with metrics, base_failed, host_rate and kept, one row for each row of docs.

    Null and empty texts have no words and fail. Rows repeated are judged and counted each. Other columns pass
    through, but for those named as the results. Texts are measured once and written with their metrics; they are
    never shuffled unless the host table itself is too large to broadcast.
    """
    return judge(store(text_rules(docs, text), "ruled"), host, max_rate)
