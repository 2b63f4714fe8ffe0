"""The registered queries over the driver's tables, and their SQL.

Queries whose name begins with star_ are plain DataFrame work on the sales tables, not operators
of the transcript engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkweave.config import VadConfig
from talkweave.functions import scalars
from talkweave.functions import text as T
from talkweave.operators import evaluation, intervals, knowledge, merge, quality, timeline, vad
from talkweave.plans import parts  # noqa: F401  (registers its queries)
from talkweave.plans.inputs import ENERGIES, SEGMENTS, energies, segments, table, visits
from talkweave.plans.registry import ORACLES, QUERIES, query
from talkweave.session import materialized
from talkweave.sources import videos
from talkweave.streaming import committer

FLAGSHIP = "quality_flags_by_conv"
#: Repeats at the end of a text, without back-references: the last unit equals those before it.
_BARE = "replace(replace(replace(text, chr(10), ''), chr(13), ''), ' ', '')"
_TAIL = """(length(t) >= 3 * 6 AND len(list_filter(range(6, 31), lambda u: length(t) >= 3 * u AND substr(t, length(t) - u + 1, u) = substr(t, length(t) - 2 * u + 1, u) AND substr(t, length(t) - u + 1, u) = substr(t, length(t) - 3 * u + 1, u))) > 0 OR {short})"""
_SHORT = """(length(t) >= 5 AND len(list_filter(range(1, 4), lambda u: length(t) >= 5 * u AND substr(t, length(t) - 5 * u + 1, 5 * u) = repeat(substr(t, length(t) - u + 1, u), 5))) > 0)"""
_TAIL = _TAIL.replace("{short}", _SHORT)


@query(f"SELECT doc_id, {_TAIL} AS repeated, {_SHORT} AND length(t) >= 5 AND len(list_distinct(string_split(t, ''))) <= 2 AS garbled FROM (SELECT doc_id, coalesce({_BARE}, '') AS t FROM documents)")
def repeat_tail_docs(spark: SparkSession, sf: str) -> DataFrame:
    """F7, F8."""
    return table(spark, sf, "documents").select("doc_id", T.repeated_tail(F.col("text")).alias("repeated"), T.garbled(F.col("text")).alias("garbled"))


_ROLE_RUNS = """
  SELECT conv_id, max(run) AS run, sum(run) AS n, count(DISTINCT t) AS kinds FROM (
    SELECT conv_id, t, count(*) AS run FROM (
      SELECT conv_id, t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, t ORDER BY turn) AS island
      FROM (SELECT conv_id, turn, {t} AS t FROM seg) WHERE t <> '') GROUP BY conv_id, t, island) GROUP BY conv_id"""
_REPEATED = "coalesce(n >= 3 AND (run >= 3 OR (n >= 6 AND kinds / n < 0.5)), false)"
_STRIP = r"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


@query(f"WITH {SEGMENTS}, runs AS ({_ROLE_RUNS.replace('{t}', 'role')}) SELECT conv_id, {_REPEATED} AS repeated FROM (SELECT DISTINCT conv_id FROM seg) LEFT JOIN runs USING (conv_id)")
def repeated_roles_by_conv(spark: SparkSession, sf: str) -> DataFrame:
    """F9 over roles, which repeat more than texts."""
    rows = segments(spark, sf).drop("text").withColumnRenamed("role", "text")
    return quality.repeated_segments(rows, "conv_id", "turn")


_DIAGNOSE = f"""WITH {SEGMENTS}, runs AS ({_ROLE_RUNS.replace("{t}", _STRIP.replace("{t}", "coalesce(text, '')"))}),
m AS (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS whole, count(*) AS segments,
        coalesce(max(no_speech_prob), 0) AS max_no_speech, coalesce(min(avg_logprob), 0) AS min_logprob, coalesce(max(compression_ratio), 0) AS max_compression,
        avg(no_speech_prob) AS avg_ns,
        count(*) FILTER (avg_logprob <= -1 OR compression_ratio >= 2.4 OR (no_speech_prob >= 0.85 AND {_STRIP.replace("{t}", "coalesce(text, '')")} <> '')) AS flagged
      FROM seg GROUP BY conv_id),
d AS (SELECT m.*, {_STRIP.replace("{t}", "whole")} AS text, {_REPEATED} AS repeated FROM m LEFT JOIN runs USING (conv_id)),
e AS (SELECT *, {_BARE} AS t, contains(text, 'ご視聴ありがとうございました') AS phrase FROM d)
SELECT conv_id, text, segments, max_no_speech, min_logprob, max_compression, flagged, repeated,
  array_to_string(list_filter([CASE WHEN {_TAIL} THEN 'repeat_tail' END, CASE WHEN repeated THEN 'repeat_segments' END, CASE WHEN phrase THEN 'hallucination_phrase_match' END, CASE WHEN flagged > 0 THEN 'low_confidence_segments' END], lambda x: x IS NOT NULL), ',') AS flags,
  CASE WHEN text = '' THEN false
       WHEN phrase AND (max_no_speech >= 0.6 OR (max_compression >= 2.4 AND min_logprob <= -1)) THEN true
       WHEN max_no_speech >= 0.85 OR avg_ns >= 0.75 THEN true
       ELSE max_compression >= 2.4 AND min_logprob <= -1 END AS forced_silence
FROM e"""


@query(_DIAGNOSE)
def quality_flags_by_conv(spark: SparkSession, sf: str) -> DataFrame:
    """F5, F6, F7, F9, F12, A4, A5, A6 in one."""
    found = quality.diagnostics(segments(spark, sf), "conv_id", "turn")
    return found.withColumn("flags", F.array_join("flags", ","))


@query(f"WITH {SEGMENTS} SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN avg_logprob <= -1 THEN 'low_logprob' END, CASE WHEN compression_ratio >= 2.4 THEN 'high_compression_ratio' END, CASE WHEN no_speech_prob >= 0.85 AND {_STRIP.replace('{t}', 'text')} <> '' THEN 'high_no_speech' END], lambda x: x IS NOT NULL), ',') AS reasons FROM seg WHERE avg_logprob <= -1 OR compression_ratio >= 2.4 OR (no_speech_prob >= 0.85 AND {_STRIP.replace('{t}', 'text')} <> '')")
def flagged_segments(spark: SparkSession, sf: str) -> DataFrame:
    """F6."""
    return quality.flagged_segments(segments(spark, sf)).select("conv_id", "turn", F.array_join("reasons", ",").alias("reasons"))


@query(f"SELECT conv_id, {_STRIP.replace('{t}', 'whole')} AS text FROM (SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS whole FROM conversations GROUP BY conv_id)")
def transcript_text_by_conv(spark: SparkSession, sf: str) -> DataFrame:
    """A6, T1."""
    return quality.combined_text(table(spark, sf, "conversations"), "conv_id", ["turn"])


#: A third of the turns gets Japanese fillers: in front, between delimiters, or nothing else. Inner line breaks keep a leading filler's delimiter.
_SQUEEZE = r"regexp_replace(regexp_replace({t}, '[、,]{2,}', '、', 'g'), '\s{2,}', ' ', 'g')"


@query(rf"""WITH f AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CASE WHEN contains(text, chr(10)) THEN '、' || text ELSE text END WHEN 1 THEN text || '、、はい' WHEN 2 THEN '' ELSE text END AS t FROM conversations),
c AS (SELECT conv_id, turn, {_SQUEEZE.replace("{t}", "t")} AS t FROM f), b AS (SELECT conv_id, turn, CASE WHEN regexp_full_match(t, '[\s、。,.!?…ー〜]*') THEN '' ELSE t END AS t FROM c)
SELECT conv_id, {_STRIP.replace("{t}", "string_agg(t, '' ORDER BY turn)")} AS text FROM b GROUP BY conv_id""")
def filler_removed(spark: SparkSession, sf: str) -> DataFrame:
    """R1, R2."""
    rows = table(spark, sf, "conversations").withColumn("text", F.when(F.col("turn") % 4 == 0, F.concat(F.lit("えーと、"), "text")).when(F.col("turn") % 4 == 1, F.concat("text", F.lit("、うーん、はい"))).when(F.col("turn") % 4 == 2, F.lit("んー")).otherwise(F.col("text")))
    return quality.without_fillers(rows, "conv_id", "turn")


#: Decode attempts out of conversations: even turns loop by construction, every third has no second attempt.
_ATTEMPTS = "SELECT conv_id, turn, 1 AS attempt_no, CASE WHEN turn % 2 = 0 THEN repeat(text, 5) ELSE text END AS text FROM conversations UNION ALL SELECT conv_id, turn, 2, CASE WHEN turn % 4 = 0 THEN repeat(text, 5) ELSE text END FROM conversations WHERE turn % 2 = 0 AND turn % 3 <> 2"
_JUDGED = f"SELECT conv_id, turn, attempt_no, text, {_TAIL} AS looping, {_SHORT} AND len(list_distinct(string_split(t, ''))) <= 2 AS garbled FROM (SELECT *, {_BARE} AS t FROM ({_ATTEMPTS}))"


@query(f"""WITH j AS ({_JUDGED}), p AS (SELECT a.conv_id, a.turn, a.text AS t1, a.looping AS l1, a.garbled AS g1, b.text AS t2, b.looping AS l2, b.attempt_no AS n2 FROM (FROM j WHERE attempt_no = 1) a LEFT JOIN (FROM j WHERE attempt_no = 2) b USING (conv_id, turn)),
d AS (SELECT *, CASE WHEN l1 AND g1 THEN 'silence' WHEN l1 AND n2 IS NULL THEN 'retry' WHEN l1 AND l2 THEN 'silence' ELSE 'keep' END AS decision FROM p)
SELECT conv_id, turn, decision, CASE decision WHEN 'keep' THEN CASE WHEN l1 AND NOT g1 THEN t2 ELSE t1 END WHEN 'silence' THEN '' END AS text FROM d""")
def retry_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """C2, F7, F8, F10."""
    rows = table(spark, sf, "conversations")
    loop = lambda k: F.when(F.col("turn") % k == 0, F.repeat("text", F.lit(5))).otherwise(F.col("text"))
    one = rows.select("conv_id", "turn", F.lit(1).alias("attempt_no"), loop(2).alias("text"))
    two = rows.where("turn % 2 = 0 and turn % 3 <> 2").select("conv_id", "turn", F.lit(2).alias("attempt_no"), loop(4).alias("text"))
    judged = one.unionByName(two).withColumn("condition", F.lit(None).cast("boolean")).withColumn("repeated", F.lit(False)).withColumn("forced", F.lit(False))
    return quality.retry_decision(judged, ["conv_id", "turn"])


_KTA = r"""t AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS n, count(*) OVER () AS all_, regexp_extract(text, '\w+') AS term FROM benchmark),
p AS (SELECT doc_id, [a.term, b.term, 'the'] AS terms, regexp_replace(text, '\s+', ' ', 'g') AS text FROM documents JOIN t a ON a.n = doc_id % a.all_ JOIN t b ON b.n = (doc_id // 7) % b.all_),
k AS (SELECT doc_id, len(list_filter(list_filter(terms, lambda x: coalesce(x, '') <> ''), lambda x: CASE WHEN regexp_full_match(x, '[A-Za-z0-9_ ]+') THEN regexp_matches(text, '(^|[^A-Za-z0-9_])' || x || '($|[^A-Za-z0-9_])') ELSE contains(text, x) END)) / len(list_filter(terms, lambda x: coalesce(x, '') <> ''))::DOUBLE AS accuracy FROM p)"""


@query(f"WITH {_KTA} SELECT doc_id, accuracy FROM k")
def kta_benchmark_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Two terms out of the benchmark, by document, and one that is common."""
    items = table(spark, sf, "benchmark").select("item_id", F.regexp_extract("text", r"\w+", 0).alias("term"))
    n = items.count()
    terms = items.withColumn("n", F.row_number().over(Window.orderBy("item_id")) - 1).select("n", "term")  # the benchmark is a small, fixed table
    docs = table(spark, sf, "documents").withColumn("n", F.col("doc_id") % n).withColumn("m", F.floor(F.col("doc_id") / 7) % n)
    docs = docs.join(terms, "n").join(terms.select(F.col("n").alias("m"), F.col("term").alias("other")), "m")
    return docs.select("doc_id", evaluation.key_term_accuracy(F.col("text"), F.array("term", "other", F.lit("the"))).alias("accuracy"))


@query(f"WITH {_KTA} SELECT count(*) AS samples, round(avg(accuracy), 9) AS avg_kta FROM k")
def kta_average(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    return evaluation.average(kta_benchmark_terms(spark, sf)).select("samples", F.round("avg_kta", 9).alias("avg_kta"))


_SIMHASH = """tok AS (SELECT doc_id, unnest(CASE WHEN len(w) > 0 THEN w ELSE [text] END) AS token FROM (SELECT doc_id, text, list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)),
h AS (SELECT doc_id, ('0x' || left(md5(token), 16))::UBIGINT AS v FROM tok),
sim AS (SELECT doc_id, format('{:016x}', sum(CASE WHEN votes >= 0 THEN 1::UBIGINT << i ELSE 0::UBIGINT END)::UBIGINT) AS simhash
  FROM (SELECT doc_id, i, sum(CASE WHEN (v >> i) & 1 = 1 THEN 1 ELSE -1 END) AS votes FROM h, (SELECT unnest(range(64))::INT AS i) GROUP BY doc_id, i) GROUP BY doc_id)"""


@query(f"WITH {_SIMHASH} SELECT doc_id, simhash FROM sim")
def simhash_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A7, R10 with the native token hash."""
    return knowledge.simhash(table(spark, sf, "documents"), "doc_id", "text", "md5")


@query(f"WITH {_SIMHASH} SELECT doc_id, simhash FROM (SELECT *, row_number() OVER (PARTITION BY simhash ORDER BY doc_id) AS n FROM sim WHERE doc_id % 3 > 0) WHERE n = 1 AND simhash NOT IN (SELECT simhash FROM sim WHERE doc_id % 3 = 0)")
def simhash_new_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the documents arrive, a third is there already."""
    hashed = knowledge.simhash(table(spark, sf, "documents"), "doc_id", "text", "md5")
    return knowledge.new_by_hash(hashed.where("doc_id % 3 > 0"), hashed.where("doc_id % 3 = 0"), "simhash", "doc_id")


@query()
def simhash_blake2b(spark: SparkSession, sf: str) -> DataFrame:
    """A7 with the exact token hash."""
    return knowledge.simhash(table(spark, sf, "documents"), "doc_id", "text")


_A, _B = ("[" + ", ".join(map(str, x)) + "]" for x in knowledge.minhash_factors())


@query(f"""WITH t AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) > 0 THEN w ELSE [text] END)) AS token FROM (SELECT doc_id, text, list_filter(string_split(regexp_replace(lower(text), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)),
h AS (SELECT doc_id, (('0x' || left(md5(token), 8))::BIGINT >> 1) % {knowledge.PRIME} AS h FROM t), f AS (SELECT unnest(range({knowledge.MINHASHES})) AS k, unnest({_A}::BIGINT[]) AS a, unnest({_B}::BIGINT[]) AS b)
SELECT doc_id, list(m ORDER BY k) AS signature FROM (SELECT doc_id, k, min((h * a + b) % {knowledge.PRIME}) AS m FROM h, f GROUP BY doc_id, k) GROUP BY doc_id""")
def minhash_docs(spark: SparkSession, sf: str) -> DataFrame:
    """A8."""
    return knowledge.minhash(table(spark, sf, "documents"), "doc_id", "text")


@query(f"WITH {_SIMHASH}, n AS (SELECT count(DISTINCT simhash) AS created FROM sim) SELECT (SELECT count(*) FROM documents) AS discovered, created, (SELECT count(*) FROM documents) - created AS skipped, 0 AS failed FROM n")
def kb_ingest_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A11, E2 on documents as files."""
    rows = table(spark, sf, "documents").select(F.format_string("/kb/%012d.txt", "doc_id").alias("path"), "text", F.lit(None).cast("string").alias("error"))
    return knowledge.ingest(rows, token_hash="md5")[2]


@query(f"WITH {ENERGIES} SELECT user_id, frame_idx, round(coalesce(sum(energy) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) / 5, 6) AS energy FROM en")
def energy_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """W1."""
    return vad.smoothed(energies(spark, sf), "energy", 5, "user_id").select("user_id", "frame_idx", F.round("energy", 6).alias("energy"))


_THRESHOLD = "t AS (SELECT user_id, least(least(greatest(noise * 2.5, 0.0005), CASE WHEN peak > noise THEN noise + 0.3 * (peak - noise) ELSE peak END), 0.95 * peak) AS v FROM (SELECT user_id, quantile_cont(energy, 0.2) AS noise, max(energy) AS peak FROM en GROUP BY user_id)), th AS (SELECT user_id, CASE WHEN v IS NULL OR v <= 0 THEN 0.0005 ELSE v END AS on_ FROM t)"


@query(f"WITH {ENERGIES}, {_THRESHOLD} SELECT user_id, round(on_, 6) AS on_threshold, round(least(on_ * 0.7, on_), 6) AS off_threshold FROM th")
def energy_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """A2, A3."""
    got = vad.thresholds(energies(spark, sf), VadConfig(), "user_id")
    return got.select("user_id", F.round("on", 6).alias("on_threshold"), F.round("off", 6).alias("off_threshold"))


_FLAGS = f"""{_THRESHOLD},
e AS (SELECT user_id, frame_idx, CASE WHEN count(*) OVER a = 2 AND min(energy) OVER a >= on_ THEN 1 WHEN count(*) OVER b = 3 AND max(energy) OVER b <= least(on_ * 0.7, on_) THEN 0 END AS ev
  FROM en JOIN th USING (user_id) WINDOW a AS (PARTITION BY user_id ORDER BY frame_idx ROWS 1 PRECEDING), b AS (PARTITION BY user_id ORDER BY frame_idx ROWS 2 PRECEDING)),
s AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS st FROM e),
tr AS (SELECT *, CASE WHEN st <> coalesce(lag(st) OVER (PARTITION BY user_id ORDER BY frame_idx), 0) THEN st END AS turn FROM s),
fl AS (SELECT user_id, frame_idx, (st = 1 OR max((coalesce(turn, -1) = 1)::INT) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) = 1)
   AND NOT max((coalesce(turn, -1) = 0)::INT) OVER (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) = 1 AS flag FROM tr)"""


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    frames = energies(spark, sf)
    frames = frames.join(vad.thresholds(frames, VadConfig(), "user_id"), "user_id")
    return vad.hysteresis(frames, "energy", F.col("on"), F.col("off"), 2, 3, "user_id")


@query(f"WITH {ENERGIES}, {_FLAGS} SELECT user_id, frame_idx, flag FROM fl")
def hysteresis_flags(spark: SparkSession, sf: str) -> DataFrame:
    """W2, A3."""
    return _flagged(spark, sf).select("user_id", "frame_idx", "flag")


@query(f"""WITH {ENERGIES}, {_FLAGS}, r AS (SELECT user_id, min(frame_idx) * 160 AS s, max(frame_idx) * 160 + 480 AS e FROM (SELECT *, frame_idx - row_number() OVER (PARTITION BY user_id ORDER BY frame_idx) AS g FROM fl WHERE flag) GROUP BY user_id, g),
m AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 320 THEN 0 ELSE 1 END AS n FROM r),
i AS (SELECT user_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY user_id, g)
SELECT user_id, greatest(s - 80, 0) AS start_sample, e + 80 AS end_sample FROM i WHERE e - s >= 640""")
def speech_segments(spark: SparkSession, sf: str) -> DataFrame:
    """W3, W4, W5, F3, F4 over hysteresis flags."""
    runs = intervals.true_runs(_flagged(spark, sf), "user_id", "frame_idx", "flag")
    spans = runs.select("user_id", (F.col("first") * 160).alias("start_sample"), (F.col("last") * 160 + 480).alias("end_sample"))
    kept = intervals.merged(spans, "user_id", "start_sample", "end_sample", 320).where(intervals.long_enough(F.col("start_sample"), F.col("end_sample"), 640))
    low, high = intervals.padded(F.col("start_sample"), F.col("end_sample"), 80, F.lit(1 << 62))
    return kept.select("user_id", low.cast("long").alias("start_sample"), high.alias("end_sample"))


@query("""WITH v AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 5400000000 AS e FROM events),
m AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 21600000000 THEN 0 ELSE 1 END AS n FROM v)
SELECT user_id, min(s) AS start_us, max(e) AS end_us FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY user_id, g""")
def session_islands(spark: SparkSession, sf: str) -> DataFrame:
    """W5, G6."""
    return intervals.merged(visits(spark, sf), "user_id", "start_us", "end_us", 6 * 3_600_000_000)


@query(f"WITH {ENERGIES} SELECT user_id, frame_idx, round(sum(abs(energy)) OVER w / count(*) OVER w, 6) AS energy FROM en WINDOW w AS (PARTITION BY user_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)")
def frame_energy(spark: SparkSession, sf: str) -> DataFrame:
    """A1 on hops of one sample."""
    hops = energies(spark, sf).select("user_id", "frame_idx", F.abs("energy").alias("sum_abs"), F.lit(1).alias("n"))
    return vad.frame_energies(hops, 3, "user_id").select("user_id", "frame_idx", F.round("energy", 6).alias("energy"))


@query(f"""WITH {ENERGIES}, f AS (SELECT user_id, frame_idx FROM en), s AS (SELECT user_id, least(greatest(1 - coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE (event_id % 100) / 100.0 END, 0), 0), 1)::DOUBLE AS p, unnest(range(frame_idx // 2, (frame_idx + event_id % 7 + 1) // 2)) AS frame_idx FROM en),
b AS (SELECT user_id, frame_idx, max(p) AS p FROM s GROUP BY ALL) SELECT user_id, frame_idx, round(coalesce(p, 0), 6) AS probability FROM f LEFT JOIN b USING (user_id, frame_idx)""")
def frame_projection(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of a length by event id, some without a score."""
    rows = energies(spark, sf)
    at = F.col("frame_idx").cast("double")
    score = F.when(F.col("event_type") == "view", F.lit(None).cast("double")).otherwise(F.col("event_id") % 100 / F.lit(100.0))
    segs = rows.select("user_id", at.alias("start"), F.floor((F.col("frame_idx") + F.col("event_id") % 7 + 1) / 2).cast("double").alias("half"), score.alias("no_speech_prob")).select("user_id", "start", (F.col("half") * 2).alias("end"), "no_speech_prob")
    got = intervals.frame_probabilities(rows.select("user_id", "frame_idx"), segs, 2.0, "user_id")
    return got.select("user_id", "frame_idx", F.round("probability", 6).alias("probability"))


_PLAN = f"""{SEGMENTS}, sp AS (SELECT conv_id, start_ms * 16 AS s, end_ms * 16 AS e FROM seg WHERE turn % 3 = 1), tot AS (SELECT conv_id, max(end_ms) * 16 AS total FROM seg GROUP BY conv_id),
x AS (SELECT conv_id, greatest(s - 16000, 0) AS s, least(e + 16000, total) AS e FROM sp JOIN tot USING (conv_id)),
m AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY conv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS n FROM x WHERE e > s),
r AS (SELECT conv_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m) GROUP BY conv_id, g
      UNION ALL SELECT conv_id, 0, total FROM tot WHERE conv_id NOT IN (SELECT conv_id FROM sp)),
c AS (SELECT conv_id, s, e, unnest(range(s, greatest(e, s + 1), 400000)) AS main_start FROM r),
plan AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY main_start) - 1 AS chunk_idx, greatest(main_start - 16000, s) AS raw_start, least(least(main_start + 400000, e) + 16000, e) AS raw_end, main_start, least(main_start + 400000, e) AS main_end FROM c)"""


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    segs = segments(spark, sf)
    speech = segs.where("turn % 3 = 1").select("conv_id", (F.col("start_ms") * 16).alias("start_sample"), (F.col("end_ms") * 16).alias("end_sample"))
    total = segs.groupBy("conv_id").agg((F.max("end_ms") * 16).alias("total"))
    return intervals.chunk_plan(total, speech, 400_000, 16_000, 16_000, "conv_id")


@query(f"WITH {_PLAN} SELECT * FROM plan")
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Every third turn is speech."""
    return _plan(spark, sf)


@query(f"WITH {_PLAN} SELECT conv_id, chunk_idx, turn, greatest(start_ms / 1000.0::DOUBLE, main_start / 16000.0::DOUBLE) AS start_s, least(end_ms / 1000.0::DOUBLE, main_end / 16000.0::DOUBLE) AS end_s FROM seg JOIN plan USING (conv_id) WHERE end_ms / 1000.0::DOUBLE > main_start / 16000.0::DOUBLE AND start_ms / 1000.0::DOUBLE < main_end / 16000.0::DOUBLE")
def clip_segments(spark: SparkSession, sf: str) -> DataFrame:
    """F2, J4."""
    windows = _plan(spark, sf).select("conv_id", "chunk_idx", (F.col("main_start") / F.lit(16000.0)).alias("window_start"), (F.col("main_end") / F.lit(16000.0)).alias("window_end"))
    segs = segments(spark, sf).select("conv_id", "turn", (F.col("start_ms") / F.lit(1000.0)).alias("start"), (F.col("end_ms") / F.lit(1000.0)).alias("end"))
    return intervals.clipped_to(segs, windows, ["conv_id"]).select("conv_id", "chunk_idx", "turn", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


def _chunked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Conversations decoded in chunks of 25 s with 1 s of overlap: (segments with duplicates in the overlaps, windows)."""
    segs = segments(spark, sf)
    total = segs.groupBy("conv_id").agg((F.max("end_ms") * 16).alias("total"))
    windows = intervals.chunk_plan(total, total.select("conv_id", F.lit(0).cast("long").alias("start_sample"), F.col("total").alias("end_sample")).where("false"), 400_000, 16_000, 0, "conv_id")
    timed = segs.select("conv_id", F.col("turn").alias("seq"), (F.col("start_ms") / F.lit(1000.0)).alias("start"), (F.col("end_ms") / F.lit(1000.0)).alias("end"), "text", "avg_logprob", "no_speech_prob", "compression_ratio", F.lit(0.0).alias("temperature"))
    windows = materialized(windows)
    low_raw, high_raw = F.col("raw_start") / 16000, F.col("raw_end") / 16000
    inside = intervals.beside(timed, windows, ["conv_id"], F.col("start"), F.col("end"), low_raw, high_raw).where((F.col("end") > low_raw) & (F.col("start") < high_raw))
    shift = F.col("raw_start") / F.lit(16000.0)
    low, high = F.greatest(F.col("start"), shift) - shift, F.least(F.col("end"), F.col("raw_end") / F.lit(16000.0)) - shift
    return materialized(inside.select("conv_id", "chunk_idx", "seq", low.alias("start"), high.alias("end"), "text", "avg_logprob", "no_speech_prob", "compression_ratio", "temperature")), windows


#: M1 to M6 row by row. Two different utterances of a conversation never overlap here, so the same text stands for the similarity of M3.
_MERGE = f"""{SEGMENTS.lstrip()}, tot AS (SELECT conv_id, max(end_ms) * 16 AS total FROM seg GROUP BY conv_id),
w AS (SELECT conv_id, m // 400000 AS chunk_idx, greatest(m - 16000, 0) AS rs, least(least(m + 400000, total) + 16000, total) AS re, m AS ms, least(m + 400000, total) AS me FROM (SELECT conv_id, total, unnest(range(0, greatest(total, 1), 400000)) AS m FROM tot)),
x AS (SELECT conv_id, chunk_idx, turn AS seq, text, avg_logprob AS lp, no_speech_prob AS ns, compression_ratio AS cr, rs, re, ms, me, rs / 16000.0::DOUBLE AS off, greatest(start_ms / 1000.0::DOUBLE, rs / 16000.0::DOUBLE) - rs / 16000.0::DOUBLE AS a, least(end_ms / 1000.0::DOUBLE, re / 16000.0::DOUBLE) - rs / 16000.0::DOUBLE AS b
  FROM seg JOIN w USING (conv_id) WHERE end_ms / 1000.0::DOUBLE > rs / 16000.0::DOUBLE AND start_ms / 1000.0::DOUBLE < re / 16000.0::DOUBLE),
p AS (SELECT *, a + off AS rf, CASE WHEN b = 0 THEN a + off ELSE b END + off AS rt, ms / 16000.0::DOUBLE AS lo, me / 16000.0::DOUBLE AS hi FROM x),
q AS (SELECT *, CASE WHEN rt > lo AND rf < hi THEN greatest(rf, lo) END AS s, CASE WHEN rt > lo AND rf < hi THEN least(rt, hi) END AS e FROM p),
r AS (SELECT conv_id, chunk_idx, seq, text, regexp_replace(text, '\\s+', '', 'g') AS bare, rf, rt, s, e, coalesce((rs < ms AND greatest(s - lo, 0) <= 0.35) OR (re > me AND greatest(hi - e, 0) <= 0.35), false) AS edge,
    [least(greatest(s - lo, 0), greatest(hi - e, 0)), 3.0, lp, -ns, -abs(cr - 1), e - s] AS score, row_number() OVER (PARTITION BY conv_id ORDER BY chunk_idx, seq) AS k FROM q),
f AS (SELECT conv_id, 0::BIGINT AS k, NULL::VARCHAR AS what, NULL::BIGINT AS gone, NULL::BIGINT AS lk, NULL::VARCHAR AS bare, NULL::DOUBLE AS s, NULL::DOUBLE AS e, NULL::DOUBLE AS rf, NULL::DOUBLE AS rt, false AS edge, NULL::DOUBLE[] AS score FROM tot
  UNION ALL SELECT conv_id, k, what, CASE WHEN what = 'replaced' THEN lk END, CASE WHEN stay THEN lk ELSE k END, CASE WHEN stay THEN bare ELSE bare2 END, CASE WHEN stay THEN s ELSE s2 END, CASE WHEN stay THEN e ELSE e2 END, CASE WHEN stay THEN rf ELSE rf2 END, CASE WHEN stay THEN rt ELSE rt2 END, CASE WHEN stay THEN edge ELSE edge2 END, CASE WHEN stay THEN score ELSE score2 END
  FROM (SELECT *, what IN ('clipped', 'skipped') AS stay FROM (SELECT *, CASE WHEN s2 IS NULL THEN 'clipped' WHEN NOT dup THEN 'kept' WHEN score2 > score OR (score2 = score AND e2 >= e) THEN 'replaced' ELSE 'skipped' END AS what
    FROM (SELECT f.conv_id, r.k, f.lk, f.bare, f.s, f.e, f.rf, f.rt, f.edge, f.score, r.bare AS bare2, r.s AS s2, r.e AS e2, r.rf AS rf2, r.rt AS rt2, r.edge AS edge2, r.score AS score2,
        coalesce(f.bare <> '' AND r.bare <> '' AND ((f.bare = r.bare AND r.s - f.e <= 0.5)
          OR (r.s - f.e <= 0.35 AND greatest(0, least(f.rt, r.rt) - greatest(f.rf, r.rf)) / least(greatest(f.rt - f.rf, 1e-6), greatest(r.rt - r.rf, 1e-6)) >= 0.8 AND (f.edge OR r.edge) AND (contains(r.bare, f.bare) OR contains(f.bare, r.bare)))), false) AS dup
      FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k + 1)))),
d AS (SELECT f.conv_id, r.chunk_idx, r.seq, r.text, r.s, r.e, f.k, f.what, f.what IN ('kept', 'replaced') AND f.k NOT IN (SELECT g.gone FROM f g WHERE g.conv_id = f.conv_id AND g.gone IS NOT NULL) AS kept FROM f JOIN r ON r.conv_id = f.conv_id AND r.k = f.k)"""


@query(f"WITH RECURSIVE {_MERGE} SELECT conv_id, chunk_idx::INT AS chunk_idx, seq, what AS disposition, round(s, 6) AS start_s, round(e, 6) AS end_s, kept FROM d")
def merge_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    """What became of every segment."""
    segs, windows = _chunked(spark, sf)
    found = merge.dispositions(merge.placed(segs, windows, key="conv_id"), key="conv_id")
    return found.select("conv_id", "chunk_idx", "seq", "disposition", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"), "kept")


@query(f"WITH RECURSIVE {_MERGE} SELECT conv_id, count(*)::INT AS n_segments, {_STRIP.replace('{t}', "string_agg(text, '' ORDER BY k)")} AS text, round(arg_max(e, k), 6) AS duration FROM d WHERE kept GROUP BY conv_id")
def merged_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """M1 to M6."""
    segs, windows = _chunked(spark, sf)
    disposed = merge.dispositions(merge.placed(segs, windows, key="conv_id"), key="conv_id")
    parts = segs.groupBy("conv_id", "chunk_idx").agg(F.lit("").alias("text"), F.lit(None).cast("double").alias("duration"), F.count("*").alias("n_segments"))
    out = merge.merged_results(disposed, parts, windows, key="conv_id")
    return out.select("conv_id", F.size("segments").alias("n_segments"), "text", F.round("duration", 6).alias("duration"))


@query(f"""WITH RECURSIVE {_MERGE} SELECT conv_id, chunk_idx::INT AS chunk_idx, count(*) AS input, count(*) FILTER (what = 'clipped') AS clipped, count(*) FILTER (what = 'kept') AS kept, count(*) FILTER (what = 'skipped') AS skipped, count(*) FILTER (what = 'replaced') AS replaced
FROM d GROUP BY ROLLUP (conv_id, chunk_idx) HAVING conv_id IS NOT NULL""")
def merge_counters(spark: SparkSession, sf: str) -> DataFrame:
    """A12."""
    segs, windows = _chunked(spark, sf)
    return merge.merge_counters(merge.dispositions(merge.placed(segs, windows, key="conv_id"), key="conv_id"), "conv_id")


@query("""WITH c AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'click'), u AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events WHERE event_type = 'error')
SELECT u.event_id, u.user_id, arg_min(c.event_id, row(abs(c.t - u.t), c.event_id)) AS nearest_click FROM u LEFT JOIN c ON c.user_id = u.user_id GROUP BY ALL""")
def nearest_context(spark: SparkSession, sf: str) -> DataFrame:
    """Clicks are screens, errors are utterances."""
    rows = visits(spark, sf)
    left = rows.where("event_type = 'error'").select("user_id", F.col("start_us").alias("t"), "event_id")
    right = rows.where("event_type = 'click'").select("user_id", F.col("start_us").alias("t"), F.col("event_id").alias("click"))
    return timeline.nearest(left, right, "user_id", "t", "click", "nearest_click").select("event_id", "user_id", "nearest_click")


@query(f"""WITH RECURSIVE {SEGMENTS.replace("seg AS", "seg AS", 1)},
u AS (SELECT conv_id, turn, text, start_ms / 1000.0::DOUBLE AS s, end_ms / 1000.0::DOUBLE AS e, CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN end_ms / 1000.0::DOUBLE ELSE greatest(0, end_ms / 1000.0::DOUBLE - 1.0) END AS cut FROM seg),
n AS (SELECT a.conv_id, a.turn AS upd, a.cut, b.turn AS pos, b.s, b.e, b.text, row_number() OVER (PARTITION BY a.conv_id ORDER BY a.turn, b.e, b.s) AS k FROM u a JOIN u b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn),
f AS (SELECT conv_id, 0::BIGINT AS k, 0.0::DOUBLE AS until_, NULL::VARCHAR AS last, 0.0::DOUBLE AS last_end, 0 AS n_commits FROM (SELECT DISTINCT conv_id FROM u)
  UNION ALL SELECT f.conv_id, n.k, CASE WHEN n.e > n.cut OR n.e <= f.until_ + 1e-6 THEN f.until_ ELSE n.e END,
    CASE WHEN n.e > n.cut OR n.e <= f.until_ + 1e-6 OR (trim(n.text) = trim(f.last) AND n.s - f.last_end <= 0.5) THEN f.last ELSE n.text END,
    CASE WHEN n.e > n.cut OR n.e <= f.until_ + 1e-6 OR (trim(n.text) = trim(f.last) AND n.s - f.last_end <= 0.5) THEN f.last_end ELSE n.e END,
    CASE WHEN n.e > n.cut OR n.e <= f.until_ + 1e-6 OR (trim(n.text) = trim(f.last) AND n.s - f.last_end <= 0.5) THEN f.n_commits ELSE f.n_commits + 1 END
  FROM f JOIN n ON n.conv_id = f.conv_id AND n.k = f.k + 1)
SELECT conv_id, max(n_commits)::INT AS commits, round(max(until_), 6) AS duration FROM f GROUP BY conv_id""")
def commit_log(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn is an update whose window holds the turn before and itself."""
    segs = segments(spark, sf).withColumn("s", F.struct((F.col("start_ms") / F.lit(1000.0)).alias("start"), (F.col("end_ms") / F.lit(1000.0)).alias("end"), "text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    pair = F.array_compact(F.array(F.lag("s").over(w), F.col("s")))
    last = F.lead("turn").over(w).isNull()
    updates = segs.select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("update_seq"), pair.alias("segments"), F.lit(0.0).alias("window_start"), F.col("s.end").alias("now_total"), last.alias("final"), F.lit(1.0).alias("lookback"))
    done = committer.committed(updates)
    return done.select(F.col("session").cast("long").alias("conv_id"), F.size("commits").alias("commits"), F.round("duration", 6).alias("duration"))


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[,/\n]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), '|') AS items FROM documents")
def prompt_items(spark: SparkSession, sf: str) -> DataFrame:
    """R6."""
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.prompt_items(F.col("text")), "|").alias("items"))


@query(r"""WITH c AS (SELECT doc_id, text, regexp_extract_all(text, '[^。、,]+|[。、,]') AS cl FROM documents),
k AS (SELECT doc_id, text, cl, list_filter(range(1, len(cl) + 1), lambda i: list_sum(list_transform(cl[1:i], lambda x: length(x))) > 896) AS over_ FROM c WHERE length(text) > 896)
SELECT doc_id, text AS prompt FROM documents WHERE length(text) <= 896 UNION ALL SELECT doc_id, regexp_replace(array_to_string(cl[1:over_[1] - 1], ''), '^\s+|\s+$', '', 'g') FROM k""")
def prompt_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """R9."""
    return table(spark, sf, "documents").select("doc_id", T.truncated_prompt(F.col("text")).alias("prompt"))


@query(rf"""WITH i AS (SELECT conv_id, array_agg(DISTINCT role ORDER BY role) AS roles, arg_min(text, turn) AS first FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, roles, list_filter(list_transform(regexp_split_to_array(first, '[,/
]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS items FROM i),
j AS (SELECT conv_id, '{T.STYLE["en"]}' || CASE WHEN len(items) > 0 THEN ' 議題: ' || array_to_string(items, ', ') ELSE '' END || ' 参加者: ' || array_to_string(roles, ', ') AS text FROM p),
c AS (SELECT conv_id, text, regexp_extract_all(text, '[^。、,]+|[。、,]') AS cl FROM j), k AS (SELECT *, list_filter(range(1, len(cl) + 1), lambda i: list_sum(list_transform(cl[1:i], lambda x: length(x))) > 896) AS over_ FROM c)
SELECT conv_id, CASE WHEN length(text) <= 896 THEN text ELSE regexp_replace(array_to_string(cl[1:over_[1] - 1], ''), '^\s+|\s+$', '', 'g') END AS prompt FROM k""")
def initial_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """R6, R7, R8 on conversations as metadata."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.min_by("text", "turn").alias("first"))
    return rows.select("conv_id", T.initial_prompt(T.style_guidance(F.lit("en")), participants=F.col("roles"), agenda=T.prompt_items(F.col("first"))).alias("prompt"))


@query("SELECT source, (n // 50)::BIGINT AS batch, array_to_string(list(doc_id ORDER BY doc_id), ',') AS items FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY source, n // 50")
def pack_batches(spark: SparkSession, sf: str) -> DataFrame:
    """S6."""
    return videos.batched(table(spark, sf, "documents"), "source", "doc_id", 50).withColumn("items", F.array_join(F.transform("items", lambda i: i.cast("string")), ","))


@query("""WITH m AS (SELECT label, list(v ORDER BY i) AS c FROM (SELECT label, i, avg(v) AS v FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings) GROUP BY label, i) GROUP BY label),
s AS (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c), 6) AS score FROM embeddings JOIN m USING (label))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def embedding_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The vectors nearest to the centre of their label."""
    rows = table(spark, sf, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("centre"))
    scored = rows.join(centres, "label").select("label", "vec_id", F.round(scalars.cosine(F.col("embedding"), F.col("centre")), 6).alias("score"))
    w = Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


_SIZE = "CASE WHEN n <= 0 THEN '0B' WHEN n < 1024 THEN format('{:.2f}B', n::DOUBLE) WHEN n < 1048576 THEN format('{:.2f}KB', n / 1024) ELSE format('{:.2f}MB', n / 1048576) END"


@query(f"SELECT conv_id, turn, {_SIZE} AS size, format('{{:02d}}:{{:02d}}', end_ms // 60000, (end_ms // 1000) % 60) AS clock, peak, n - coalesce(before, n) AS delta FROM (WITH {SEGMENTS} SELECT *, max(n) OVER (PARTITION BY conv_id ORDER BY turn) AS peak, lag(n) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT *, length(text) * 37 AS n FROM seg))")
def sizes_and_clocks(spark: SparkSession, sf: str) -> DataFrame:
    """P13, P14, A13."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = segments(spark, sf).withColumn("n", (F.char_length("text") * 37).cast("long"))
    return rows.select("conv_id", "turn", scalars.byte_size(F.col("n")).alias("size"), scalars.clock(F.col("end_ms") / F.lit(1000.0)).alias("clock"), F.max("n").over(w).alias("peak"), (F.col("n") - F.coalesce(F.lag("n").over(w), F.col("n"))).alias("delta"))


@query("SELECT source, count(*) AS n_docs, sum(quality)::BIGINT AS good, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source")
def label_quality_join(spark: SparkSession, sf: str) -> DataFrame:
    """Join and aggregate baseline."""
    return table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def star_pricing(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS orders FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def star_nation_revenue(spark: SparkSession, sf: str) -> DataFrame:
    t = lambda n: table(spark, sf, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def star_top_orders(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", F.row_number().over(w).alias("rank")).where("rank <= 3")
