"""Quality rules whose thresholds are chosen under a guarantee from labelled documents.

Every rule is a feature with a cut-off for each step of one fixed path from lenient to strict; a step sets all rules at
once. In each stratum (by default the language) a step is certified when the exact binomial test on the stratum's labelled
good documents rejects "the rules at this step, taken together, reject more than `alpha` of the good documents that the
base rules let pass". Steps are tested in order and testing stops at the first failure (fixed-sequence testing needs no
further correction); over strata the level `delta` is split evenly (Bonferroni). So with probability 1 - `delta`, in every
stratum at once, the rules in force reject at most `alpha` of the good documents that pass the base rules. What the base
rules reject is given by them and no part of the guarantee. A stratum with too few labelled good documents (under 72 for
one stratum, about 100 for four, at 5 and 5 percent) gets no step, and only the base rules hold there.

A trial of a test is a distinct doc_id of the stratum: rows that repeat an id count once, by the strictest of their steps.
Null text has no words and fails the base rules; so does empty text. A very long text is described in its task as a whole.
A null stratum is a stratum of its own. A null id has no label. Documents without labels are judged all the same. Ties with
a cut-off pass. An empty table gives an empty result; without labels nothing is certified. Columns beside doc_id, text and
the stratum are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, documents, labels, text_bytes, text_slices

ALPHA, DELTA = 0.05, 0.05
#: Thresholds are broadcast up to so many strata (about 100 bytes each), and joined beyond.
BROADCAST_STRATA = 10_000

_SYMBOLS = b"#*$%&|<>"
_SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_NOT_IN_WORDS = bytes(range(0x80, 0xC0)) + _SPACES
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def features_of(text: bytes) -> tuple[int, ...]:
    words = text.split()
    seen, dup, lines = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip(_SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    return len(words), len(text.translate(None, _NOT_IN_WORDS)), len(text) - len(text.translate(None, _SYMBOLS)), dup, repeat_words(words), lines, len(set(words))


def text_features(docs: DataFrame, *keep: str) -> DataFrame:
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            columns = zip(*map(features_of, texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in columns)], [*batch.schema.names[:-1], *FEATURES])

    return text_bytes(docs, *keep).mapInArrow(run, f"{kept}, " + ", ".join(f"{f} bigint" for f in FEATURES))


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


#: name: (sign, numerator, denominator, cut-offs by step). The signed ratio (0 over 0) grows as a document grows worse; it fails above the cut-off.
RULES = {
    "symbols": (1, "n_symbols", "n_words", (3.0, 2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15)),
    "dup_lines": (1, "n_dup_lines", "n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "long_words": (1, "word_chars", "n_words", (40.0, 30.0, 20.0, 15.0, 13.0, 12.0, 11.5, 11.0, 10.5, 10.0, 9.5, 9.0)),
    "short_words": (-1, "word_chars", "n_words", (-1.2, -1.5, -2.0, -2.25, -2.5, -2.75, -3.0, -3.1, -3.2, -3.3, -3.4, -3.5)),
    "repeats": (1, "n_repeat_words", "n_words", (0.48, 0.46, 0.44, 0.42, 0.4, 0.38, 0.35, 0.32, 0.28, 0.24, 0.2, 0.15)),
    "few_words": (-1, "n_distinct_words", "n_words", (-0.02, -0.03, -0.05, -0.07, -0.09, -0.1, -0.12, -0.14, -0.16, -0.18, -0.2, -0.22)),
}
STEPS = 12


def worse(name: str) -> Column:
    sign, a, b, _ = RULES[name]
    return F.when(F.col(b) > 0, sign * (F.col(a) / F.col(b))).otherwise(F.lit(0.0))


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(at most k of n), exactly up to rounding: terms in logarithms, summed from the largest."""
    if k >= n:
        return 1.0
    log_p, log_q = math.log(p), math.log1p(-p)
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * math.fsum(math.exp(t - top) for t in terms))


def certify(n: int, rejected: list[int], alpha: float, level: float) -> int | None:
    """The strictest step certified in sequence. rejected[i]: good documents that step i rejects, of n."""
    best = None
    for step, k in enumerate(rejected):
        # the mean alone refutes it: no sum needed, so a test costs at most alpha * n terms
        if n == 0 or k > alpha * n or binomial_cdf(k, n, alpha) > level:
            break
        best = step
    return best


def steps_passed(name: str) -> Column:
    """How many steps of the path a document passes by one rule; cut-offs only grow stricter, so it is the first that rejects it."""
    ratio = worse(name)
    return reduce(lambda a, b: a + b, ((ratio <= F.lit(c)).cast("int") for c in RULES[name][3]))


def certified_steps(judged: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> tuple[DataFrame, int]:
    """A row for each stratum: n_good and the certified step (null: none); and how many strata there are.

    judged: doc_id, the stratum and `passed` (steps) of labelled good documents that the base rules let pass.
    """
    trials = judged.groupBy(stratum, "doc_id").agg(F.min("passed").alias("passed"))
    counts = trials.groupBy(stratum).agg(F.count("*").alias("n_good"), *(F.sum((F.col("passed") <= i).cast("long")).alias(f"k{i}") for i in range(STEPS)))
    counts = Scratch(judged.sparkSession, "thresholds").write(counts, "counts")
    strata = counts.count()
    level, kind = delta / max(1, strata), judged.schema[stratum].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [certify(r["n_good"], [r[f"k{i}"] for i in range(STEPS)], alpha, level) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], [stratum, "n_good", "certified_step"])

    return counts.mapInArrow(run, f"`{stratum}` {kind}, n_good bigint, certified_step int"), strata


def quality_rules(docs: DataFrame, labelled: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the stratum, features, base_failed, certified_step, failed_rule and kept. labelled: doc_id, quality (1: good)."""
    scratch = Scratch(docs.sparkSession, "quality-rules")
    base = text_features(docs, "doc_id", stratum).withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    base = scratch.write(base, "features")
    good = labelled.where(F.col("quality") == 1).select("doc_id").distinct()
    passed = F.least(*map(steps_passed, RULES))
    held = base.where("NOT base_failed").join(good, "doc_id").select("doc_id", stratum, passed.alias("passed"))
    found, strata = certified_steps(held, stratum, alpha, delta)
    found = found.select(F.col(stratum).alias("__stratum"), "certified_step")
    if strata <= BROADCAST_STRATA:
        found = F.broadcast(found)
    judged = base.join(found, F.col(stratum).eqNullSafe(F.col("__stratum")), "left")
    failed = reduce(lambda rest, name: F.when(steps_passed(name) <= F.col("certified_step"), F.lit(name)).otherwise(rest), reversed(list(RULES)), F.lit(None).cast("string"))
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(failed)
    return judged.select("doc_id", stratum, *FEATURES, "base_failed", "certified_step", failed.alias("failed_rule")).withColumn("kept", F.col("failed_rule").isNull())


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(documents(spark, sf_dir), labels(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule", "certified_step")


def _oracle(alpha: float = ALPHA, delta: float = DELTA) -> str:
    ratio = {name: f"CASE WHEN {b} > 0 THEN {sign} * ({a} / {b}) ELSE 0.0 END" for name, (sign, a, b, _) in RULES.items()}
    passed = ", ".join(f"len(list_filter([{', '.join(f'CAST({c!r} AS DOUBLE)' for c in cuts)}], lambda c: {ratio[name]} <= c))::INTEGER AS p_{name}" for name, (*_, cuts) in RULES.items())
    least = f"least({', '.join(f'p_{name}' for name in RULES)})"
    sums = ", ".join(f"count(*) FILTER (WHERE p <= {i}) AS k{i}" for i in range(STEPS))
    rows = ", ".join(f"{{'i': {i}, 'k': k{i}}}" for i in range(STEPS))
    share = f"CAST({alpha!r} AS DOUBLE)"
    cdf = f"list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({share}) + (n_good - j) * ln(1 - {share}))))"
    failed = " ".join(f"WHEN p_{name} <= certified_step THEN '{name}'" for name in RULES)
    return rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines FROM documents),
v AS (SELECT doc_id, list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS v FROM w WHERE len(w) > 2),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (SELECT doc_id, unnest(v) AS k, generate_subscripts(v, 1) AS i FROM v)),
o AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM x WHERE c > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(o.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(list_distinct(w))::BIGINT AS n_distinct_words FROM w LEFT JOIN o ON o.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {passed} FROM f),
t AS (SELECT lang, doc_id, min({least}) AS p FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang, doc_id),
g AS (SELECT lang, count(*) AS n_good, {sums} FROM t GROUP BY lang),
k AS (SELECT lang, n_good, unnest([{rows}], recursive := true) FROM g),
l AS (SELECT {delta!r} / greatest(1, count(*)) AS level FROM g),
q AS (SELECT *, CASE WHEN k > {share} * n_good THEN FALSE WHEN k >= n_good THEN 1 <= level ELSE {cdf} <= level END AS passed FROM k, l),
s AS (SELECT *, bool_and(passed) OVER (PARTITION BY lang ORDER BY i) AS certified FROM q),
c AS (SELECT lang, max(i)::INTEGER AS certified_step FROM s WHERE certified GROUP BY lang),
j AS (SELECT b.*, certified_step, CASE WHEN base_failed THEN 'base' {failed} END AS failed_rule FROM b LEFT JOIN c ON b.lang IS NOT DISTINCT FROM c.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule, certified_step FROM j"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": _oracle()}
