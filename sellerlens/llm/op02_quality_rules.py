"""Quality rules with host verdicts.

Each document is judged by its own text (the base rule). The failures are
counted per host, every host's failure rate is shrunk towards the corpus rate
with a beta prior fitted to the hosts themselves (method of moments), and a
host whose shrunken rate exceeds `max_host_failure` loses all its documents.

Scale: the text is read once by an Arrow UDF in the map stage (twice by the filter form). Hosts are
summed with partial aggregation (a host with a third of all rows sends one row
per task), the prior is one row, and the verdicts join back to rows of a few
numbers. The filter form never shuffles texts while the rejected hosts fit the
checked broadcast bound.

Defined cases: a null or empty text has no words and fails the base rule; a very long text is measured whole, alone; a
null host has no verdict, its documents stand or fall by the base rule; equal
rows are judged one by one; an empty table gives an empty result; other
columns, whatever their names, are neither read nor changed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sellerlens.llm.common import fresh, table, written
from sellerlens.llm.textops import Words, chunks, mix, per_doc, text_bytes
from sellerlens.plans.broadcast import broadcast_if_small

MIN_WORDS = 50
MAX_REPEAT_PCT = 50
#: A host is rejected when its shrunken failure rate is above this.
MAX_HOST_FAILURE = 0.5
#: Bounds of the prior's strength (alpha + beta, in documents).
PRIOR_STRENGTH = (1.0, 1e6)

SYMBOLS = "#*$%&|<>"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])

_SYMBOL_BYTE = np.zeros(256, bool)
_SYMBOL_BYTE[[ord(c) for c in SYMBOLS]] = True


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def repeated_words(words: Words, n: int = 3) -> np.ndarray:
    """Per word: is it in a run of `n` words that its document has twice or more?"""
    hit = np.zeros(len(words.start), bool)
    grams, at = words.grams(n)
    if len(at):
        key = mix(grams + words.doc[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        where = at[order[twice]]
        for k in range(n):
            hit[where + k] = True
    return hit


def text_stats(texts: pa.Array) -> pa.Array:
    """The five counts of each text."""
    out = {f: [] for f in FIELDS}
    for lo, hi in chunks(texts):
        data, offs = text_bytes(texts.slice(lo, hi - lo))
        w = Words(data, offs)
        out["n_words"].append(w.count)
        out["word_chars"].append(per_doc(w.word_byte & ((data & 0xC0) != 0x80), offs))
        out["n_symbols"].append(per_doc(_SYMBOL_BYTE[data], offs))
        out["n_dup_lines"].append(np.array([_duplicate_lines(w.bytes_of(d)) for d in range(hi - lo)], np.int64))
        out["n_repeat_words"].append(per_doc(repeated_words(w), w.first))
    cols = [pa.array(np.concatenate(v) if v else np.zeros(0), pa.int64()) for v in out.values()]
    return pa.StructArray.from_arrays(cols, names=list(FIELDS))


def stats(text: Column) -> Column:
    """The five counts of a text column, as a struct."""

    def count(texts: pa.Array) -> pa.Array:
        return text_stats(texts)

    return F.arrow_udf(count, STATS)(text)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PCT * s["n_words"])


def host_failures(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """Documents and failures of each host: host, n, failures."""
    return (
        judged.filter(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    )


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """(alpha, beta) by the method of moments over the hosts; (0, 0) without hosts.

    The spread of the hosts' rates beyond what binomial noise explains sets the
    strength, kept within PRIOR_STRENGTH.
    """
    n, f, k, sq = hosts.agg(
        F.sum("n"), F.sum("failures"), F.count("*"), F.sum(F.col("failures") * F.col("failures") / F.col("n"))
    ).first()
    if not n:
        return 0.0, 0.0
    mean = f / n
    noise = mean * (1 - mean)
    between = sq / n - mean * mean - noise * k / n
    low, high = PRIOR_STRENGTH
    strength = high if between <= noise / (high + 1) else max(low, noise / between - 1)
    return mean * strength, (1 - mean) * strength


def host_verdicts(hosts: DataFrame, max_host_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """host, n, failures, shrunken_rate, rejected."""
    alpha, beta = beta_prior(hosts)
    rate = (F.col("failures") + F.lit(alpha)) / (F.col("n") + F.lit(alpha + beta))
    return hosts.withColumn("shrunken_rate", rate).withColumn("rejected", rate > F.lit(max_host_failure))


def judge(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text",
          max_host_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept, host_rejected."""
    s = F.col("s")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), stats(F.col(text)).alias("s"))
    rows = written(rows.select("doc_id", "host", "s.*", base_failed(s).alias("base_failed")), "quality")
    verdicts = host_verdicts(host_failures(rows, "host", "base_failed"), max_host_failure)
    rejected = F.coalesce(F.col("rejected"), F.lit(False))
    return rows.join(verdicts.select("host", "rejected"), "host", "left").select(
        "doc_id", *FIELDS, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"),
        rejected.alias("host_rejected"),
    )


def keep_good(docs: DataFrame, host: str = "source", text: str = "text",
              max_host_failure: float = MAX_HOST_FAILURE) -> DataFrame:
    """The documents that pass, with the columns of `docs`."""
    failed, bad = fresh("failed", docs), fresh("rejected_host", docs)
    # texts are measured twice, since a table of all documents with their verdicts would hold the whole input once more
    short = docs.select(F.col(host), stats(F.col(text)).alias("s"))
    counts = written(host_failures(short.select(host, base_failed(F.col("s")).alias(failed)), host, failed), "hosts")
    rejected = host_verdicts(counts, max_host_failure).filter("rejected").select(F.col("host").alias(bad))
    judged = docs.withColumn(failed, base_failed(stats(F.col(text)))).filter(~F.col(failed))
    return judged.join(broadcast_if_small(rejected), F.col(host) == F.col(bad), "left_anti").select(*docs.columns)


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
with words as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
grams as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select r, w, unnest(range(1, len(w) - 1)) as i from words where len(w) >= 3)),
twice as (select r, i from grams qualify count(*) over (partition by r, g) > 1),
covered as (
  select r, count(distinct i + k) as n from twice, (select unnest([0, 1, 2]) as k) group by r),
lines as (
  select r, count(*) - count(distinct line) as n
  from (select r, unnest(string_split(text, chr(10))) as line from words)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
base as (
  select words.r, doc_id, source, len(w) as n_words,
         length(array_to_string(w, '')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
         coalesce(lines.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words
  from words left join covered using (r) left join lines using (r)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base),
hosts as (
  select source, count(*) as n, sum(base_failed::int)::double as f
  from judged where source is not null group by source),
moments as (
  select sum(f) / sum(n) as mean, sum(n) as docs, count(*) as k, sum(f * f / n) as sq from hosts),
prior as (
  select mean, mean * (1 - mean) as noise,
         sq / docs - mean * mean - mean * (1 - mean) * k / docs as between_hosts from moments),
strength as (
  select mean, case when between_hosts <= noise / (1e6 + 1) then 1e6
                    else greatest(1.0, noise / between_hosts - 1) end as s from prior),
verdicts as (
  select source, (f + mean * s) / (n + s) > 0.5 as rejected from hosts, strength)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and not coalesce(rejected, false) as kept, coalesce(rejected, false) as host_rejected
from judged left join verdicts using (source)
"""
