"""Registered queries over payloads, grams, vocabularies, filters and passages.

All read whole tables and whole texts (no window cap).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bytesieve.functions import sizing
from bytesieve.functions.codec import hex_decode, hex_encode, uint, windows
from bytesieve.functions.hashing import poly_hash, sign, slot
from bytesieve.operators import bloom, counts, order, search, topk, vocabulary
from bytesieve.operators.counts import gram_hex
from bytesieve.plans.inputs import documents, hex_payloads, passages, payloads, table, texts
from bytesieve.plans.registry import query
from bytesieve.plans.sql_parts import PAYLOADS, gram_counts, tiers
from bytesieve.plans.sql_parts import windows as windows_sql
from bytesieve.session import materialize

N = 5
HASHES = 8
SLOTS = 100_003

WINS = f"WITH {PAYLOADS}, {windows_sql(N)}"
COUNTS = f"{WINS}, {gram_counts()}"
TIER_COUNTS = f"{WINS}, {gram_counts('tier')}"


def _counts(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    return counts.count_grams(texts(spark, sf_dir), n)


def _tier_counts(spark: SparkSession, sf_dir: str, n: int = N) -> DataFrame:
    return counts.count_grams(payloads(spark, sf_dir), n, by=("tier",))


def _split_tiers(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Gram counts of each tier, all from one pass over the texts."""
    tiered = materialize(_tier_counts(spark, sf_dir), "tier-counts")
    return {tier: tiered.where(F.col("tier") == tier).select("gram", "cnt") for tier in ("gold", "bad", "normal")}


def _stepped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.stepped_windows(texts(spark, sf_dir), N, ["doc_id"])


STEPPED = f"""{WINS}, starts AS (
  SELECT doc_id, coalesce(sum(w) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT doc_id, count(*) AS w FROM wins GROUP BY doc_id)),
stepped AS (SELECT w.gram_hex, CAST(s.start + w.i + 1 AS BIGINT) AS step FROM wins w JOIN starts s ON w.doc_id = s.doc_id)"""


# --- scalar functions -------------------------------------------------------------------

DIRTY = f"""WITH {PAYLOADS}, hexed AS (SELECT doc_id, lower(hex(payload)) AS h FROM payloads),
dirty AS (SELECT doc_id, CASE doc_id % 6
    WHEN 1 THEN '  ' || upper(h) || chr(10) WHEN 2 THEN h || 'a' WHEN 3 THEN h || 'zz'
    WHEN 4 THEN 'ab cd' || chr(9) || '0f ' || h WHEN 5 THEN 'a b' || h ELSE h END AS line, h FROM hexed)"""


def _dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("payload_hex")
    kind = F.col("doc_id") % 6
    line = (
        F.when(kind == 1, F.concat(F.lit("  "), F.upper(text), F.lit("\n")))
        .when(kind == 2, F.concat(text, F.lit("a")))
        .when(kind == 3, F.concat(text, F.lit("zz")))
        .when(kind == 4, F.concat(F.lit("ab cd\t0f "), text))
        .when(kind == 5, F.concat(F.lit("a b"), text))
        .otherwise(text)
    )
    return hex_payloads(spark, sf_dir).select("doc_id", line.alias("payload_hex"))


@query(
    f"""{DIRTY} SELECT doc_id,
      md5(CASE WHEN doc_id % 6 IN (0, 1) THEN h END) AS strict_md5,
      md5(CASE WHEN doc_id % 6 IN (0, 1) THEN h WHEN doc_id % 6 = 4 THEN 'abcd0f' || h END) AS lenient_md5
    FROM dirty"""
)
def hex_decoding(spark, sf_dir):
    """Strict hex decoding in both dialects of dirty payload lines."""
    line = F.col("payload_hex")
    return _dirty(spark, sf_dir).select(
        "doc_id",
        F.md5(hex_encode(hex_decode(line))).alias("strict_md5"),
        F.md5(hex_encode(hex_decode(line, inner_space=True))).alias("lenient_md5"),
    )


@query("SELECT item_id, lower(hex(encode(text))) AS payload_hex FROM benchmark")
def hex_encoding(spark, sf_dir):
    """Hex text of passages."""
    return passages(spark, sf_dir).select("item_id", hex_encode(F.col("payload")).alias("payload_hex"))


@query()
def hash_slots(spark, sf_dir):
    """Per seed the grams in each hundredth of the slots, and the sum of their signs."""
    grams = _counts(spark, sf_dir).select("gram")
    seeds = F.array(
        *[
            F.struct(
                F.lit(number).alias("seed_no"),
                slot(F.col("gram"), number, SLOTS).alias("slot"),
                sign(F.col("gram"), number).alias("sign"),
            )
            for number in range(HASHES)
        ]
    )
    placed = grams.select(F.inline(seeds))
    return placed.groupBy("seed_no", F.floor(F.col("slot") * 100 / SLOTS).alias("part")).agg(
        F.count("*").alias("grams"), F.sum("sign").alias("sign_sum")
    )


@query(f"{COUNTS} SELECT seed_no, grams, true AS in_range, true AS even, true AS balanced "
       f"FROM (SELECT count(*) AS grams FROM counts), (SELECT unnest(range({HASHES}))::INTEGER AS seed_no)")
def hash_slot_bounds(spark, sf_dir):
    """Per seed all slots in range, spread evenly, with as many signs of either kind, within six deviations."""
    grams, mean = F.col("grams"), F.col("grams") / 100
    by_seed = hash_slots(spark, sf_dir).groupBy("seed_no").agg(
        F.sum("grams").alias("grams"), F.sum("sign_sum").alias("sign_sum"), F.max("grams").alias("fullest"),
        F.min("part").alias("least"), F.max("part").alias("greatest"),
    )
    return by_seed.select(
        "seed_no",
        "grams",
        ((F.col("least") >= 0) & (F.col("greatest") < 100)).alias("in_range"),
        (F.col("fullest") <= mean * 1.01 + 6 * F.sqrt(mean)).alias("even"),
        (F.abs("sign_sum") <= 6 * F.sqrt(grams)).alias("balanced"),
    )


@query(
    f"""{WINS} SELECT doc_id, count(*) AS wins, CAST(sum(i) AS BIGINT) AS offset_sum,
      min(gram_hex) AS least_gram, max(gram_hex) AS greatest_gram FROM wins GROUP BY doc_id"""
)
def byte_windows(spark, sf_dir):
    """All windows of each payload."""
    wins = windows(texts(spark, sf_dir), N, keep=("doc_id",))
    # Grams of one length compare like the numbers they spell. A group's least number is kept in place, while least bytes
    # would have all windows sorted by document first.
    number = uint(F.col("gram"), 1, N)
    summed = wins.groupBy("doc_id").agg(
        F.count("*").alias("wins"),
        F.sum("i").alias("offset_sum"),
        F.min(number).alias("least"),
        F.max(number).alias("greatest"),
    )

    def spelled(name: str) -> Column:
        return F.lower(F.lpad(F.hex(name), 2 * N, "0")).alias(f"{name}_gram")

    return summed.select("doc_id", "wins", "offset_sum", spelled("least"), spelled("greatest"))


@query(
    f"""WITH {PAYLOADS}, hexed AS (SELECT doc_id, hex(payload) AS h FROM payloads)
    SELECT doc_id, list_reduce(list_prepend(0::BIGINT,
        list_transform(regexp_extract_all(h, '..'), lambda b: ('0x' || b)::BIGINT)),
      lambda a, b: (a * 257 + b) % 1000000007) AS poly FROM hexed"""
)
def polynomial_hash(spark, sf_dir):
    """P5: polynomial hash of each whole payload."""
    return texts(spark, sf_dir).select("doc_id", poly_hash(F.col("payload")).alias("poly"))


@query(
    """WITH found AS (SELECT doc_id, text, strpos(text, 'tion ') AS place FROM documents)
    SELECT doc_id, CASE WHEN place = 0 THEN -1 ELSE octet_length(encode(substr(text, 1, place - 1)))::INTEGER END AS position,
      -1 AS empty_position FROM found"""
)
def needle_position(spark, sf_dir):
    """First byte position of a needle in each payload; an empty needle has none."""
    data = F.col("payload")
    return payloads(spark, sf_dir).select(
        "doc_id",
        search.position(F.lit(b"tion "), data).alias("position"),
        search.position(F.lit(b""), data).alias("empty_position"),
    )


@query(
    f"""{TIER_COUNTS} SELECT tier, count(*) AS n_added,
      CAST(floor(count(*) * 8.0::DOUBLE / ln(2.0::DOUBLE)) AS BIGINT) AS num_bits FROM counts GROUP BY tier"""
)
def filter_sizes(spark, sf_dir):
    """Filter bits of each tier's vocabulary at eight hashes."""
    sizes = _tier_counts(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n_added"))
    return sizes.withColumn("num_bits", sizing.filter_bits(F.col("n_added"), F.lit(HASHES)))


@query(
    f"""{TIER_COUNTS}, sized AS (SELECT tier, count(*)::DOUBLE AS n, 1000003::DOUBLE AS m FROM counts GROUP BY tier),
    filled AS (SELECT *, exp(-8.0::DOUBLE * n / m) AS p0 FROM sized)
    SELECT tier, round(p0, 9) AS zero_share,
      CAST(floor(n * (pow(1.0::DOUBLE - p0, 8.0::DOUBLE) / 9.0::DOUBLE)) AS BIGINT) AS add_no,
      CAST(n AS BIGINT) - CAST(floor(n * (pow(1.0::DOUBLE - p0, 8.0::DOUBLE) / 9.0::DOUBLE)) AS BIGINT) AS add_ok
    FROM filled"""
)
def filter_forecast(spark, sf_dir):
    """Expected fill and false adds of a one-million-bit filter per tier."""
    sized = _tier_counts(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))
    bits, added, k = F.lit(1_000_003), F.col("n"), F.lit(HASHES)
    return sized.withColumn("add_no", sizing.false_adds(bits, added, k)).select(
        "tier",
        F.round(sizing.zero_bit_share(bits, added, k), 9).alias("zero_share"),
        "add_no",
        (F.col("n") - F.col("add_no")).alias("add_ok"),
    )


@query(
    f"""{TIER_COUNTS}, sized AS (SELECT tier, count(*)::DOUBLE AS n, {SLOTS}::DOUBLE AS m FROM counts GROUP BY tier)
    SELECT tier, round(n / 9.0::DOUBLE * pow(n / m, 8.0::DOUBLE), 3) AS no_seat,
      round((n - n / 9.0::DOUBLE * pow(n / m, 8.0::DOUBLE)) / m, 6) AS load_factor FROM sized"""
)
def unseated_forecast(spark, sf_dir):
    """Keys without a seat when each tier's grams try eight slots."""
    sized = _tier_counts(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"))
    lost = sizing.unseated_keys(F.lit(SLOTS), F.col("n"), F.lit(HASHES))
    return sized.select(
        "tier",
        F.round(lost, 3).alias("no_seat"),
        F.round((F.col("n") - lost) / F.lit(float(SLOTS)), 6).alias("load_factor"),
    )


@query(
    f"""{TIER_COUNTS}, sized AS (SELECT tier, count(*) AS n FROM counts GROUP BY tier),
    raw AS (SELECT tier, n, pow(n::DOUBLE / {SLOTS}::DOUBLE, 8.0::DOUBLE) / 9.0::DOUBLE AS p0 FROM sized),
    share AS (SELECT tier, n, least(greatest((sqrt(1.0::DOUBLE + 32.0::DOUBLE * p0) - 1.0::DOUBLE) / 16.0::DOUBLE, 0), 1) AS p FROM raw)
    SELECT tier, n AS distinct_grams, round(p, 9) AS collide_share, CAST(floor(n * p) AS BIGINT) AS no_seat,
      round((n - floor(n * p)) / {SLOTS}::DOUBLE, 6) AS load_factor FROM share"""
)
def saturation_estimate(spark, sf_dir):
    """Collision estimate of an eight-choice table from each tier's distinct grams."""
    sized = _tier_counts(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("distinct_grams"))
    return counts.saturation(sized, SLOTS, HASHES).select(
        "tier", "distinct_grams", F.round("collide_share", 9).alias("collide_share"), "no_seat",
        F.round("load_factor", 6).alias("load_factor"),
    )


@query(
    f"""{TIER_COUNTS} SELECT tier, round((1099511627776.0::DOUBLE - sum((cnt >= 2)::INT)::DOUBLE - count(*)::DOUBLE)
      / 1099511627776.0::DOUBLE * 100.0::DOUBLE, 9) AS unseen_rate FROM counts GROUP BY tier"""
)
def unseen_gram_rate(spark, sf_dir):
    """Share of all five-byte grams not yet added, per tier."""
    added = _tier_counts(spark, sf_dir).groupBy("tier").agg(
        F.count_if(F.col("cnt") >= 2).alias("ok"), F.count("*").alias("tmp_ok")
    )
    rate = sizing.unseen_rate(N, F.col("ok"), F.col("tmp_ok"))
    return added.select("tier", F.round(rate, 9).alias("unseen_rate"))


@query(f"{COUNTS} SELECT CAST(sum(cnt) AS BIGINT) AS magnitude_sum, count(*) AS keys FROM counts")
def counter_magnitude(spark, sf_dir):
    """Signed counters of single grams keep their counts as magnitudes."""
    signed = _counts(spark, sf_dir).withColumn("counter", sign(F.col("gram"), 0) * F.col("cnt"))
    return signed.agg(
        F.sum(sizing.magnitude(F.col("counter"))).alias("magnitude_sum"), F.count("*").alias("keys")
    )


# --- filters ----------------------------------------------------------------------------

@query(
    f"""{DIRTY}, data AS (SELECT CASE WHEN doc_id % 6 IN (0, 1) THEN length(h) // 2 END AS bytes FROM dirty)
    SELECT count(*) AS payloads, count(*) FILTER (bytes IS NULL) AS undecodable,
      count(*) FILTER (bytes < 200) AS too_short, count(*) FILTER (bytes >= 200) AS kept FROM data"""
)
def decode_drops(spark, sf_dir):
    """payload lines dropped as undecodable or as shorter than a limit."""
    return counts.drop_counts(_dirty(spark, sf_dir), 200)


@query(f"{COUNTS} SELECT gram_hex, cnt FROM counts WHERE cnt > 10")
def frequent_grams(spark, sf_dir):
    """grams counted more than ten times."""
    return topk.frequent(_counts(spark, sf_dir)).select(gram_hex(), "cnt")


# --- joins ------------------------------------------------------------------------------

@query(f"{tiers()} SELECT doc_id, num_wins, hits, denied FROM verdicts")
def screen_verdicts(spark, sf_dir):
    """Hits in the bad vocabulary and verdict of each normal payload."""
    every = payloads(spark, sf_dir)
    bad = materialize(vocabulary.train_bad_beside_gold(every, N), "bad-vocabulary")
    return vocabulary.screen(every.where(F.col("tier") == "normal"), bad, N)


@query(
    f"""{TIER_COUNTS} SELECT CASE WHEN g.gram_hex IS NULL THEN 'kept' ELSE 'skipped' END AS fate,
      count(*) AS grams, CAST(sum(b.cnt) AS BIGINT) AS wins
    FROM counts b LEFT JOIN (SELECT gram_hex FROM counts WHERE tier = 'gold') g ON b.gram_hex = g.gram_hex
    WHERE b.tier = 'bad' GROUP BY 1"""
)
def skip_known(spark, sf_dir):
    """Bad grams kept and those skipped because gold has them."""
    tiered = materialize(_tier_counts(spark, sf_dir), "tier-counts")
    bad = tiered.where(F.col("tier") == "bad").select("gram", "cnt")
    gold = tiered.where(F.col("tier") == "gold")
    kept = vocabulary.without_known(bad, gold)
    skipped = vocabulary.known_in(bad, gold)

    def summary(grams, fate):
        return grams.agg(F.count("*").alias("grams"), F.sum("cnt").alias("wins")).select(
            F.lit(fate).alias("fate"), "grams", "wins"
        )

    return summary(kept, "kept").unionByName(summary(skipped, "skipped")).where(F.col("grams") > 0)


@query(
    f"""WITH {PAYLOADS}, {windows_sql(N)}, {gram_counts(where="tier = 'gold'")},
    asked AS (SELECT item_id, unnest(range(octet_length(p) - 4)) AS i, p FROM (SELECT item_id, encode(text) AS p FROM benchmark)),
    grams AS (SELECT DISTINCT lower(hex(p[i + 1 : i + 5])) AS gram_hex FROM asked)
    SELECT g.gram_hex, coalesce(c.cnt, 0) AS cnt FROM grams g LEFT JOIN counts c ON g.gram_hex = c.gram_hex"""
)
def gram_lookup(spark, sf_dir):
    """Gold count of each gram of the passages, 0 where gold has none."""
    gold = payloads(spark, sf_dir).where(F.col("tier") == "gold")
    stored = materialize(counts.count_grams(gold, N), "gold-counts")
    asked = windows(passages(spark, sf_dir), N).select("gram").distinct()
    return counts.lookup_counts(asked, stored).select(gram_hex(), "cnt")


@query(
    f"""{WINS} SELECT gram_hex FROM wins GROUP BY gram_hex
    HAVING bool_or(tier = 'normal') AND bool_or(tier <> 'normal')"""
)
def known_grams(spark, sf_dir):
    """Normal grams that the gold or the bad generation already holds."""
    tiered = materialize(_tier_counts(spark, sf_dir), "tier-counts")
    normal = tiered.where(F.col("tier") == "normal").select("gram")
    return vocabulary.known_in(normal, tiered.where(F.col("tier") != "normal")).select(gram_hex())


TOP_SQL = f"""{TIER_COUNTS},
left_top AS (SELECT gram_hex, cnt FROM counts WHERE tier = 'normal' ORDER BY cnt DESC, gram_hex LIMIT 1000),
right_top AS (SELECT gram_hex, cnt FROM counts WHERE tier = 'gold' ORDER BY cnt DESC, gram_hex LIMIT 400)"""


def _two_tops(spark, sf_dir):
    tiered = materialize(_tier_counts(spark, sf_dir), "tier-counts").select("tier", "gram", "cnt")
    left = topk.top_grams(tiered.where(F.col("tier") == "normal"), 1000).drop("tier")
    right = topk.top_grams(tiered.where(F.col("tier") == "gold"), 400).drop("tier")
    return left, right


@query(
    f"""{TOP_SQL} SELECT gram_hex, cnt, CASE WHEN gram_hex IN (SELECT gram_hex FROM right_top)
      THEN 'both' ELSE 'only_left' END AS side FROM left_top
    UNION ALL SELECT gram_hex, cnt, CASE WHEN gram_hex IN (SELECT gram_hex FROM left_top)
      THEN 'both_right' ELSE 'only_right' END FROM right_top"""
)
def compare_tops(spark, sf_dir):
    """Rows of two top-k tables by whether the other has their gram."""
    left, right = _two_tops(spark, sf_dir)
    parts = [
        (topk.only_left(left, right), "only_left"),
        (topk.also_right(left, right), "both"),
        (topk.only_left(right, left), "only_right"),
        (topk.also_right(right, left), "both_right"),
    ]
    merged = None
    for rows, side in parts:
        named = rows.select(gram_hex(), "cnt", F.lit(side).alias("side"))
        merged = named if merged is None else merged.unionByName(named)
    return merged


@query(
    """SELECT d.doc_id, b.item_id,
      octet_length(encode(substr(d.text, 1, strpos(d.text, b.text)::INT - 1)))::BIGINT AS position
    FROM documents d JOIN benchmark b ON contains(d.text, b.text)"""
)
def find_passages(spark, sf_dir):
    """Documents that contain a passage, with its first byte position."""
    texts = documents(spark, sf_dir).select("doc_id", F.col("text").cast("binary").alias("payload"))
    return search.find_passages(texts, passages(spark, sf_dir))


# --- aggregations -----------------------------------------------------------------------

@query(f"{COUNTS} SELECT gram_hex, cnt FROM counts")
def exact_counts(spark, sf_dir):
    """G1: exact count of every gram."""
    return _counts(spark, sf_dir).select(gram_hex(), "cnt")


@query(
    f"""{COUNTS} SELECT gram_hex, least(cnt, 50) AS cnt, greatest(cnt - 50, 0) AS ceilings FROM counts"""
)
def ceiling_counts(spark, sf_dir):
    """Counters held at a ceiling, with the adds that hit it."""
    return counts.capped(_counts(spark, sf_dir), 50).select(gram_hex(), "cnt", "ceilings")


@query()
def heavy_hitter_sketch(spark, sf_dir):
    """Most frequent grams per tier by a bounded sketch."""
    wins = windows(payloads(spark, sf_dir), N, keep=("tier",))
    return counts.heavy_hitters(wins, 100, tracked=100_000, by=("tier",))


TRACKED = 100_000


HEAVY_SQL = f"""{TIER_COUNTS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY cnt DESC, gram_hex) AS place,
      7 * sum(cnt) OVER (PARTITION BY tier) AS slack FROM counts),
    last AS (SELECT tier, cnt AS least FROM ranked WHERE place = 100),
    clear AS (SELECT tier, count(*) AS clear FROM ranked JOIN last USING (tier)
      WHERE (cnt - least) * {TRACKED} > slack GROUP BY tier)
    SELECT tier, clear, clear AS found, true AS within_bound FROM clear"""


def _heavy_within_bounds(sketch, tiered):
    """Per tier: grams clearly among the hundred most frequent, those found, and whether all counts are near enough."""
    named = sketch.select("tier", F.unhex("gram_hex").alias("gram"), F.col("cnt").alias("estimate"))
    totals = tiered.groupBy("tier").agg(F.sum("cnt").alias("wins"))
    tops = [topk.top_grams(tiered.where(F.col("tier") == t), 100) for t in ("gold", "bad", "normal")]
    top = tops[0].unionByName(tops[1]).unionByName(tops[2])
    # 300 rows on one side of each join; the error of one count is 3.5 * windows / tracked at most.
    last = top.groupBy("tier").agg(F.min("cnt").alias("least"))
    clear = top.join(last, "tier").join(totals, "tier").where(
        (F.col("cnt") - F.col("least")) * TRACKED > 7 * F.col("wins")
    )
    found = clear.join(named, ["tier", "gram"], "left").groupBy("tier").agg(
        F.count("*").alias("clear"), F.count("estimate").alias("found")
    )
    off = F.abs(F.col("estimate") - F.col("cnt")) * TRACKED * 2 <= 7 * F.col("wins")
    # 300 reported grams are broadcast; an inner join, and a gram that was never counted is missing from ``seen``.
    reported = named.groupBy("tier").agg(F.count("*").alias("reported"))
    checked = (
        tiered.join(F.broadcast(named), ["tier", "gram"])
        .join(totals, "tier")
        .groupBy("tier")
        .agg(F.count("*").alias("seen"), F.every(off).alias("close"))
        .join(reported, "tier")
        .select("tier", (F.col("close") & (F.col("seen") == F.col("reported"))).alias("within_bound"))
    )
    return found.join(checked, "tier")


@query(HEAVY_SQL)
def heavy_hitter_bounds(spark, sf_dir):
    """Grams clearly among the hundred most frequent are found, and counts are off by no more than stated."""
    parts = counts.partial_counts(payloads(spark, sf_dir), N, by=("tier",))
    tiered = materialize(counts.merge_counts(parts, by=("tier",)), "tier-counts")
    wins = counts.occurrences(parts)
    sketch = materialize(counts.heavy_hitters(wins, 100, tracked=TRACKED, by=("tier",)), "heavy-hitters")
    return _heavy_within_bounds(sketch, tiered)


@query(HEAVY_SQL)
def merged_heavy_hitters_bounds(spark, sf_dir):
    """The same for sketches that were stored per tier and source and combined per tier."""
    parts = counts.partial_counts(payloads(spark, sf_dir), N, by=("tier", "source"))
    tiered = materialize(counts.merge_counts(parts, by=("tier",)), "tier-counts")
    wins = counts.occurrences(parts)
    stored = materialize(counts.heavy_sketch(wins, tracked=TRACKED, by=("tier", "source")), "heavy-sketches")
    merged = materialize(counts.merge_heavy(stored, tracked=TRACKED, by=("tier",)), "merged-sketches")
    sketch = materialize(counts.heavy_from(merged, 100, by=("tier",)), "heavy-hitters")
    return _heavy_within_bounds(sketch, tiered)


@query()
def signed_frequency_sketch(spark, sf_dir):
    """Estimates of the signed-counter sketch beside exact counts."""
    exact = materialize(_counts(spark, sf_dir), "counts")
    pages = materialize(counts.dense_sketch(counts.signed_sketch(exact, SLOTS), SLOTS), "dense-sketch")
    return counts.estimate_dense(exact, pages, SLOTS).select(gram_hex(), "cnt", "estimate")


@query(f"{COUNTS} SELECT count(*) AS grams, true AS mostly_near FROM counts")
def signed_sketch_bounds(spark, sf_dir):
    """At least 99 % of all estimates lie within four deviations of a counter from the exact count."""
    exact = materialize(_counts(spark, sf_dir), "counts")
    pages = materialize(counts.dense_sketch(counts.signed_sketch(exact, SLOTS), SLOTS), "dense-sketch")
    compared = counts.estimate_dense(exact, pages, SLOTS)
    # The square deviation of one counter is the sum of all squared counts over the slots.
    squares = exact.agg((F.sum(F.col("cnt").cast("double") ** 2) / SLOTS).alias("variance"))
    near = (F.col("estimate") - F.col("cnt")) ** 2 <= 16 * F.col("variance")
    return compared.crossJoin(F.broadcast(squares)).agg(
        F.count("*").alias("grams"), (F.count_if(near) >= F.count("*") * 0.99).alias("mostly_near")
    )


@query(f"{COUNTS} SELECT unnest(range(5))::INTEGER AS seed_no, windows, true AS possible FROM (SELECT CAST(sum(cnt) AS BIGINT) AS windows FROM counts)")
def sketch_magnitudes(spark, sf_dir):
    """The magnitudes of a seed's counters add up to the windows, less twice what cancelled out."""
    exact = materialize(_counts(spark, sf_dir), "counts")
    cells = counts.signed_sketch(exact, SLOTS)
    total = exact.agg(F.sum("cnt").alias("windows"))
    size = F.sum(sizing.magnitude(F.col("cell")))
    possible = (F.col("size") <= F.col("windows")) & ((F.col("windows") - F.col("size")) % 2 == 0) & (F.col("size") > 0)
    return cells.groupBy("seed_no").agg(size.alias("size")).crossJoin(F.broadcast(total)).select(
        "seed_no", "windows", possible.alias("possible")
    )


@query(
    f"""{TIER_COUNTS} SELECT gram_hex, least(CAST(sum(cnt) AS BIGINT), 65535) AS cnt FROM counts GROUP BY gram_hex"""
)
def merged_counts(spark, sf_dir):
    """Count tables of the three tiers added up under a 16-bit ceiling."""
    return counts.merge_counts(*_split_tiers(spark, sf_dir).values(), ceiling=65_535).select(gram_hex(), "cnt")


@query()
def distinct_estimate(spark, sf_dir):
    """Distinct grams of all tiers from merged per-tier sketches."""
    # A sketch takes a gram once or often alike, so each distinct one of a part is enough.
    parts = counts.partial_counts(payloads(spark, sf_dir), N, by=("tier",))
    return counts.merge_distinct(counts.distinct_sketch(parts, ("tier",)))


@query(f"{COUNTS} SELECT count(*) AS grams, true AS near FROM counts")
def distinct_bounds(spark, sf_dir):
    """The estimate from merged sketches is within 3 % of the exact number."""
    exact = counts.merge_counts(counts.partial_counts(texts(spark, sf_dir), N)).agg(F.count("*").alias("grams"))
    near = F.abs(F.col("distinct_grams") - F.col("grams")) <= F.col("grams") * 0.03
    return exact.crossJoin(distinct_estimate(spark, sf_dir)).select("grams", near.alias("near"))


@query(f"{tiers()} SELECT gram_hex, cnt FROM gold")
def gold_vocabulary(spark, sf_dir):
    """V1: gold grams and counts."""
    gold = payloads(spark, sf_dir).where(F.col("tier") == "gold")
    return vocabulary.train_vocabulary(gold, N).select(gram_hex(), "cnt")


@query(f"{tiers()} SELECT gram_hex, cnt FROM bad")
def bad_vocabulary(spark, sf_dir):
    """V2: bad grams and counts without gold grams."""
    every = payloads(spark, sf_dir)
    gold = vocabulary.train_vocabulary(every.where(F.col("tier") == "gold"), N)
    bad = vocabulary.train_vocabulary(every.where(F.col("tier") == "bad"), N, skip=(gold,))
    return bad.select(gram_hex(), "cnt")


@query(f"{tiers()} SELECT gram_hex, cnt FROM normal")
def normal_vocabulary(spark, sf_dir):
    """V3: grams and counts of the normal payloads that pass the deny rule, without bad grams."""
    return vocabulary.train_tiers(payloads(spark, sf_dir), N)["normal"].select(gram_hex(), "cnt")


@query(f"{tiers()} SELECT tier, gram_hex FROM (SELECT 'gold' AS tier, * FROM gold UNION ALL "
       "SELECT 'bad', * FROM bad UNION ALL SELECT 'normal', * FROM normal) WHERE cnt >= 2")
def second_sighting_vocabulary(spark, sf_dir):
    """V4: grams of each tier that were seen at least twice."""
    trained = vocabulary.train_tiers(payloads(spark, sf_dir), N)
    merged = None
    for tier, rows in trained.items():
        named = vocabulary.second_sightings(rows).select(F.lit(tier).alias("tier"), gram_hex())
        merged = named if merged is None else merged.unionByName(named)
    return merged


@query(
    f"""{tiers()}, seen AS (SELECT gram_hex, count(*) AS cnt FROM accepted GROUP BY gram_hex),
    marked AS (SELECT s.cnt, b.gram_hex IS NOT NULL AS known FROM seen s LEFT JOIN bad b ON s.gram_hex = b.gram_hex)
    SELECT CAST(sum(cnt) AS BIGINT) AS ngrams, CAST(coalesce(sum(cnt) FILTER (known), 0) AS BIGINT) AS add_skipped,
      count(*) FILTER (NOT known) AS add_tmp_ok, count(*) FILTER (NOT known AND cnt >= 2) AS add_ok,
      CAST(coalesce(sum(greatest(cnt - 2, 0)) FILTER (NOT known), 0) AS BIGINT) AS add_fail FROM marked"""
)
def run_counters(spark, sf_dir):
    """Run counters of normal training."""
    every = payloads(spark, sf_dir)
    bad = materialize(vocabulary.train_bad_beside_gold(every, N), "bad-vocabulary")
    accepted = vocabulary.accepted_payloads(every.where(F.col("tier") == "normal"), bad, N)
    return vocabulary.training_counters(counts.count_grams(accepted, N), bad)


@query(
    f"""{TIER_COUNTS} SELECT tier, count(*) AS add_ok, CAST(sum(cnt) AS BIGINT) - count(*) AS add_in
    FROM counts GROUP BY tier"""
)
def filter_list_counters(spark, sf_dir):
    """New and repeated adds per tier."""
    return vocabulary.list_counters(_tier_counts(spark, sf_dir))


@query(
    f"""{TIER_COUNTS}, totals AS (SELECT tier, CAST(sum(cnt) AS BIGINT) AS tries, count(*) AS keys,
      avg(cnt) AS mean_cnt, stddev_pop(cnt) AS std_cnt FROM counts GROUP BY tier),
    doors AS (SELECT *, greatest(2, tries // (1 + keys)) AS door FROM totals)
    SELECT d.tier, d.tries, d.keys, round(d.mean_cnt, 6) AS mean_cnt, round(d.std_cnt, 4) AS std_cnt, d.door,
      count(*) FILTER (c.cnt < d.door) AS below_door, round(d.keys / {SLOTS}.0::DOUBLE, 6) AS load_factor,
      round(count(*) FILTER (c.cnt < d.door) / d.keys, 6) AS below_share
    FROM doors d JOIN counts c ON c.tier = d.tier GROUP BY d.tier, d.tries, d.keys, d.mean_cnt, d.std_cnt, d.door"""
)
def counter_statistics(spark, sf_dir):
    """Counter-table statistics per tier."""
    rounded = counts.count_statistics(_tier_counts(spark, sf_dir), SLOTS, by=("tier",))
    return rounded.select(
        "tier", "tries", "keys", F.round("mean_cnt", 6).alias("mean_cnt"), F.round("std_cnt", 4).alias("std_cnt"),
        "door", "below_door", F.round("load_factor", 6).alias("load_factor"),
        F.round("below_share", 6).alias("below_share"),
    )


@query()
def bloom_fill(spark, sf_dir):
    """Bits set in each tier's filter, beside the forecast."""
    tiered = materialize(_tier_counts(spark, sf_dir), "tier-counts")
    bits = 2_000_003
    built = bloom.bits_set(bloom.build_bloom(tiered, HASHES, bits, by=("tier",)), by=("tier",))
    forecast = tiered.groupBy("tier").agg(F.count("*").alias("grams")).withColumn(
        "expected_bits",
        F.round((1 - sizing.zero_bit_share(F.lit(bits), F.col("grams"), F.lit(HASHES))) * bits).cast("long"),
    )
    return forecast.join(built, "tier")


@query(f"{TIER_COUNTS} SELECT tier, count(*) AS grams, true AS near FROM counts GROUP BY tier")
def bloom_fill_bounds(spark, sf_dir):
    """Bits set in each tier's filter are within 1 % of the forecast."""
    near = F.abs(F.col("bits_set") - F.col("expected_bits")) <= F.col("expected_bits") * 0.01
    return bloom_fill(spark, sf_dir).select("tier", "grams", near.alias("near"))


@query(
    f"""{TIER_COUNTS} SELECT count(*) AS members, count(*) AS found FROM counts WHERE tier = 'gold'"""
)
def bloom_members(spark, sf_dir):
    """A blocked filter finds every member of its vocabulary."""
    gold = payloads(spark, sf_dir).where(F.col("tier") == "gold")
    vocab = materialize(counts.count_grams(gold, N).select("gram"), "gold")
    bits = 1_000_003
    bitmaps = materialize(bloom.build_bloom(vocab, HASHES, bits, blocked=True), "gold-filter")
    return bloom.probe_blocked(vocab, bitmaps, HASHES, bits).agg(
        F.count("*").alias("members"), F.count_if("maybe").alias("found")
    )


@query()
def bloom_probe(spark, sf_dir):
    """Normal grams asked of the gold filter: members, false positives, misses."""
    tiered = materialize(_tier_counts(spark, sf_dir), "tier-counts")
    gold = tiered.where(F.col("tier") == "gold").select("gram")
    normal = tiered.where(F.col("tier") == "normal").select("gram")
    bits = 1_000_003
    bitmaps = materialize(bloom.build_bloom(gold, HASHES, bits), "gold-filter")
    asked = bloom.probe_bloom(normal, bitmaps, HASHES, bits)
    exact = asked.join(gold.withColumn("member", F.lit(True)), "gram", "left").fillna(False, ["member"])
    return exact.groupBy("member", "maybe").agg(F.count("*").alias("grams"))


PROBE_SQL = f"""{TIER_COUNTS}, asked AS (SELECT n.gram_hex, g.gram_hex IS NOT NULL AS member FROM
      (SELECT gram_hex FROM counts WHERE tier = 'normal') n LEFT JOIN
      (SELECT gram_hex FROM counts WHERE tier = 'gold') g ON n.gram_hex = g.gram_hex)
    SELECT count(*) FILTER (member) AS members, 0::BIGINT AS missed, count(*) FILTER (NOT member) AS others,
      true AS few_false FROM asked"""


@query(PROBE_SQL)
def bloom_probe_bounds(spark, sf_dir):
    """No member is missed, and other grams are found no more often than the fill lets expect."""
    split = _split_tiers(spark, sf_dir)
    bits = 1_000_003
    bitmaps = materialize(bloom.build_bloom(split["gold"], HASHES, bits), "gold-filter")
    members = split["gold"].select("gram", F.lit(True).alias("member"))
    asked = bloom.probe_bloom(split["normal"], bitmaps, HASHES, bits).join(members, "gram", "left")
    member = F.coalesce("member", F.lit(False))
    found = asked.agg(
        F.count_if(member).alias("members"), F.count_if(member & ~F.col("maybe")).alias("missed"),
        F.count_if(~member).alias("others"), F.count_if(~member & F.col("maybe")).alias("false"),
    )
    expected = F.col("others") * F.pow(F.col("bits_set") / bits, F.lit(float(HASHES)))
    few = F.col("false") <= expected * 1.1 + 6 * F.sqrt(expected) + 6
    return found.crossJoin(bloom.bits_set(bitmaps)).select("members", "missed", "others", few.alias("few_false"))


@query(PROBE_SQL)
def blocked_probe_bounds(spark, sf_dir):
    """The same for a blocked filter, whose expected share comes from the fill of its blocks."""
    split = _split_tiers(spark, sf_dir)
    bits = 1_000_003
    bitmaps = materialize(bloom.build_bloom(split["gold"], HASHES, bits, blocked=True), "blocked-filter")
    members = split["gold"].select("gram", F.lit(True).alias("member"))
    asked = bloom.probe_blocked(split["normal"], bitmaps, HASHES, bits).join(members, "gram", "left")
    member = F.coalesce("member", F.lit(False))
    found = asked.agg(
        F.count_if(member).alias("members"), F.count_if(member & ~F.col("maybe")).alias("missed"),
        F.count_if(~member).alias("others"), F.count_if(~member & F.col("maybe")).alias("false"),
    )
    expected = F.col("others") * F.col("false_share")
    few = F.col("false") <= expected * 1.1 + 6 * F.sqrt(expected) + 6
    share = bloom.blocked_false_share(bitmaps, HASHES, bits)
    return found.crossJoin(F.broadcast(share)).select("members", "missed", "others", few.alias("few_false"))


@query(
    f"""{WINS} SELECT (SELECT count(*) FROM payloads) AS packets, count(*) AS ngrams,
      count(DISTINCT gram_hex) AS distinct_grams, count(*) - count(DISTINCT gram_hex) AS repeats,
      count(*) - count(DISTINCT gram_hex) AS add_re, count(DISTINCT gram_hex) AS add_ok_or_no,
      0::BIGINT AS repeats_called_new FROM wins"""
)
def bloom_audit(spark, sf_dir):
    """Counters of an exact set beside a filter filled in reading order."""
    every = payloads(spark, sf_dir)
    stepped = order.stepped_windows(every, N, ["doc_id"])
    audit = bloom.audit_bloom(stepped, every, HASHES, 1_000_003)
    return audit.select(
        "packets", "ngrams", "distinct_grams", "repeats", "add_re", "repeats_called_new",
        (F.col("add_ok") + F.col("add_no")).alias("add_ok_or_no"),
    )


@query()
def bloom_false_positives(spark, sf_dir):
    """New grams that the filling filter refused, beside the forecast."""
    first = materialize(vocabulary.first_steps(_stepped(spark, sf_dir)), "first-steps")
    bits = 1_000_003
    refused = bloom.first_colliding(first, HASHES, bits).agg(F.count("*").alias("add_no"))
    total = first.agg(F.count("*").alias("distinct_grams"))
    joined = refused.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return joined.withColumn(
        "expected_no", sizing.false_adds(F.lit(bits), F.col("distinct_grams"), F.lit(HASHES))
    )


@query(f"{COUNTS} SELECT count(*) AS distinct_grams, true AS near FROM counts")
def bloom_false_positive_bounds(spark, sf_dir):
    """Grams refused while the filter fills are near the sum of fill ** k over all adds."""
    parts, bits = 1000, 1_000_003
    n, found = F.col("distinct_grams"), F.col("add_no")
    # The sum over all adds in a thousand equal parts, each at its middle.
    middle = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: (i + 0.5) * n / parts)
    chance = F.transform(middle, lambda added: F.pow(1 - sizing.zero_bit_share(F.lit(bits), added, F.lit(HASHES)), F.lit(float(HASHES))))
    expected = F.aggregate(chance, F.lit(0.0), lambda a, b: a + b) * n / parts
    counted = bloom_false_positives(spark, sf_dir).select("distinct_grams", "add_no", expected.alias("_expected"))
    near = F.abs(found - F.col("_expected")) <= F.col("_expected") * 0.05 + 6 * F.sqrt("_expected") + 6
    return counted.select("distinct_grams", near.alias("near"))


# --- order ------------------------------------------------------------------------------

CAPACITY = 20_000


@query(
    f"""{STEPPED}, firsts AS (SELECT gram_hex, min(step) AS step FROM stepped GROUP BY gram_hex)
    SELECT gram_hex, step, CAST((row_number() OVER (ORDER BY step) - 1) // {CAPACITY} AS INTEGER) AS generation FROM firsts"""
)
def filter_generations(spark, sf_dir):
    """Filter generation of each gram by first sighting."""
    first = vocabulary.first_steps(_stepped(spark, sf_dir))
    return vocabulary.generations(first, CAPACITY).select(gram_hex(), "step", "generation")


@query(
    f"""{STEPPED}, firsts AS (SELECT gram_hex, min(step) AS step FROM stepped GROUP BY gram_hex)
    SELECT gram_hex, CAST((row_number() OVER (ORDER BY step) - 1) // {CAPACITY} AS INTEGER) AS generation FROM firsts"""
)
def resumed_generations(spark, sf_dir):
    """Filter generations of three runs over thirds of the payloads; each refills the generation left open."""
    all_texts = texts(spark, sf_dir)
    bounds = all_texts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    step = (bounds["high"] - bounds["low"]) // 3 + 1 if bounds["low"] is not None else 1
    third = F.expr(f"(doc_id - {bounds['low'] or 0}) div {step}")
    published = materialize(spark.createDataFrame([], "gram binary, generation int"), "published")
    for run in range(3):
        first = vocabulary.first_steps(order.stepped_windows(all_texts.where(third == run), N, ["doc_id"]))
        new = vocabulary.resumed_generations(first, published, published.count(), CAPACITY)
        new = materialize(new.select("gram", "generation"), "generations")
        published = published.unionByName(new)
    return published.select(gram_hex(), "generation")


@query(
    f"""{STEPPED}, ranked AS (SELECT gram_hex, step, row_number() OVER (PARTITION BY gram_hex ORDER BY step) AS sighting FROM stepped),
    added AS (SELECT (step - 1) // 10000 AS bucket, count(*) FILTER (sighting = 1) AS tmp, count(*) FILTER (sighting = 2) AS ok
              FROM ranked WHERE sighting <= 2 GROUP BY 1),
    buckets AS (SELECT unnest(range((SELECT max(step) FROM stepped) // 10000)) AS bucket),
    curve AS (SELECT (b.bucket + 1) * 10000 AS ngrams,
      CAST(sum(coalesce(a.ok, 0)) OVER (ORDER BY b.bucket) AS BIGINT) AS add_ok,
      CAST(sum(coalesce(a.tmp, 0)) OVER (ORDER BY b.bucket) AS BIGINT) AS add_tmp_ok
    FROM buckets b LEFT JOIN added a ON a.bucket = b.bucket)
    SELECT *, round((1099511627776.0::DOUBLE - add_ok::DOUBLE - add_tmp_ok::DOUBLE)
      / 1099511627776.0::DOUBLE * 100.0::DOUBLE, 9) AS unseen_rate FROM curve"""
)
def training_curve(spark, sf_dir):
    """Totals of first and second sightings after each 10,000 windows."""
    curve = order.training_curve(texts(spark, sf_dir), N, ["doc_id"])
    return curve.withColumn("unseen_rate", F.round("unseen_rate", 9))


@query(
    """WITH firsts AS (SELECT user_id, min(event_id) AS first_seen FROM events GROUP BY user_id),
    stop AS (SELECT first_seen FROM firsts ORDER BY first_seen OFFSET 95 LIMIT 1)
    SELECT count(*) AS step FROM events WHERE event_id <= (SELECT first_seen FROM stop)
    HAVING count(*) > 0"""
)
def distinct_saturation(spark, sf_dir):
    """Events read until more than 95 users have been seen."""
    return order.saturation_step(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 95)


@query(
    f"""WITH {PAYLOADS}, sized AS (SELECT doc_id, octet_length(payload) - 3 AS w FROM payloads WHERE octet_length(payload) >= 5),
    before AS (SELECT doc_id, w, coalesce(sum(w) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM sized)
    SELECT doc_id, CAST(w AS BIGINT) AS wins FROM before WHERE b <= 1000000"""
)
def window_budget(spark, sf_dir):
    """E5: payloads read until a budget of windows is passed."""
    kept = order.within_budget(texts(spark, sf_dir), 4, 1_000_000, ["doc_id"], min_bytes=5)
    return kept.select("doc_id", (F.length("payload") - 3).cast("long").alias("wins"))


# --- top-k and sets ---------------------------------------------------------------------

@query(f"{COUNTS} SELECT gram_hex, cnt FROM counts ORDER BY cnt DESC, gram_hex LIMIT 1000")
def top_grams(spark, sf_dir):
    """The thousand most frequent grams."""
    return topk.top_grams(_counts(spark, sf_dir), 1000).select(gram_hex(), "cnt")


@query(f"{TOP_SQL} SELECT gram_hex, count(*) AS copies FROM (FROM left_top UNION ALL FROM right_top) GROUP BY gram_hex HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """Grams that two top-k tables put together hold twice."""
    left, right = _two_tops(spark, sf_dir)
    return topk.duplicate_grams(left.unionByName(right)).select(gram_hex(), "copies")


@query("SELECT DISTINCT source AS name FROM documents ORDER BY source LIMIT 7")
def first_sources(spark, sf_dir):
    """The first seven input names."""
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("name"))
    return topk.first_names(names, 7)


@query(
    f"""{TOP_SQL}, common AS (SELECT count(*) AS c FROM left_top WHERE gram_hex IN (SELECT gram_hex FROM right_top)),
    sizes AS (SELECT (SELECT count(*) FROM left_top) AS l, (SELECT count(*) FROM right_top) AS r)
    SELECT l AS left_size, r AS right_size, c AS common, round(c / least(l, r), 6) AS common_share FROM sizes, common"""
)
def top_overlap(spark, sf_dir):
    """Overlap of two top-k sets of different size."""
    left, right = _two_tops(spark, sf_dir)
    return topk.overlap(left, right).withColumn("common_share", F.round("common_share", 6))


@query(f"""{TIER_COUNTS} SELECT gram_hex FROM counts WHERE tier = 'gold'
    EXCEPT SELECT gram_hex FROM counts WHERE tier = 'normal'""")
def gram_difference(spark, sf_dir):
    """Gold grams that normal lacks."""
    split = _split_tiers(spark, sf_dir)
    return topk.gram_difference(split["gold"], split["normal"]).select(gram_hex())


@query(f"{WINS} SELECT DISTINCT gram_hex FROM wins")
def gram_union(spark, sf_dir):
    """Union of the three tiers' vocabularies."""
    return vocabulary.union_grams(*_split_tiers(spark, sf_dir).values()).select(gram_hex())


@query("SELECT CAST(ceil(2000003 / 32768) AS BIGINT) AS buckets, CAST(ceil(2000003 / 32768) AS BIGINT) AS equal_buckets")
def bloom_union(spark, sf_dir):
    """The union of per-tier filters equals the filter of all grams."""
    tiered = materialize(_tier_counts(spark, sf_dir), "tier-counts")
    bits = 2_000_003
    parts = materialize(bloom.build_bloom(tiered, HASHES, bits, by=("tier",)), "tier-filters")
    merged = bloom.merge_blooms(parts.drop("tier")).withColumnRenamed("bitmap", "merged")
    whole = bloom.build_bloom(tiered, HASHES, bits)
    same = merged.join(whole, "bucket", "full_outer")
    return same.agg(
        F.count("*").alias("buckets"), F.count_if(F.col("merged") == F.col("bitmap")).alias("equal_buckets")
    )
