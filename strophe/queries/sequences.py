"""Sequences, packing, orders and samplers."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.contracts import notes_view
from strophe.functions import arrays as a
from strophe.operators import packing, sequence
from strophe.operators.prefix import seeded_rank
from strophe.queries import op
from strophe.queries.corpus import TOKENS, U
from strophe.queries.quality import NOTES

DOCS = f"t AS (SELECT doc_id, {TOKENS} AS tok FROM documents)"
RANK = "row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1"
JOIN = "array_to_string({}, ' ')"


def docs(t):
    return t("documents").select(F.col("doc_id"), a.tokens_of(F.col("text")).alias("seq"))


def shown(seq):
    return F.md5(F.array_join(seq, " "))


# the same special tokens in the documents: a word with a full stop ends, a capital begins, 'de' and 'the' are dim
MARKED = f"""{DOCS}, mk AS (SELECT doc_id, list_transform(tok, lambda w: CASE WHEN w LIKE '%.' THEN '<E>' WHEN w IN ('de', 'the', 'la') THEN '<D>' WHEN regexp_matches(w, '^[A-Z]') THEN '<S>' WHEN length(w) = 2 THEN '<P>' ELSE w END) AS s FROM t)"""


def marked(t):
    w = lambda x: F.when(x.endswith("."), a.EOS).when(x.isin("de", "the", "la"), a.DIM).when(x.rlike("^[A-Z]"), a.BOS).when(F.length(x) == 2, a.PAD).otherwise(x)
    return docs(t).select("doc_id", F.transform("seq", w).alias("seq"))


N = 24
PADS = f"list_concat({{}}, list_transform(range(0, greatest(0, {N} - len({{}}))), lambda i: '<P>'))"


def _pad(x: str) -> str:
    return PADS.format(x, x)


def _rule_a(x: str) -> str:
    fixed = _pad(f"list_slice({x}, 1, {N})")
    return f"CASE WHEN list_contains({fixed}, '<E>') THEN {fixed} ELSE list_concat(list_slice({fixed}, 1, {N - 1}), ['<E>']) END"


def _drop(x: str, token: str) -> str:
    at = f"list_position({x}, '{token}')"
    return f"CASE WHEN {at} > 0 THEN list_concat(list_slice({x}, 1, {at} - 1), list_slice({x}, {at} + 1, len({x}))) ELSE {x} END"


@op("x04_pad_last_cell", f"WITH {MARKED} SELECT doc_id, {JOIN.format(_rule_a('s'))} AS seq FROM mk")
def x04(t):
    return marked(t).select("doc_id", F.array_join(a.pad_last_cell(F.col("seq"), N), " ").alias("seq"))


@op("x05_pad_augmented", f"WITH {MARKED}, b AS (SELECT doc_id, list_filter(s, lambda w: w <> '<P>') AS f FROM mk), c AS (SELECT doc_id, {_drop('f', '<D>')} AS d FROM b), e AS (SELECT doc_id, {_rule_a('d')} AS r FROM c) SELECT doc_id, {JOIN.format('r')} AS seq, list_position(r, '<E>') - 1 AS eos_index FROM e")
def x05(t):
    r = a.pad_augmented(F.col("seq"), N)
    return marked(t).select("doc_id", F.array_join(r, " ").alias("seq"), (F.array_position(r, a.EOS) - 1).alias("eos_index"))


SHORT = f"list_slice(s, 1, {N})"
ENDED = f"CASE WHEN list_contains({SHORT}, '<E>') THEN {SHORT} ELSE list_concat(list_slice({SHORT}, 1, len({SHORT}) - 1), ['<E>']) END"


@op("x06_pad_last_token", f"WITH {MARKED}, b AS (SELECT doc_id, s, {ENDED} AS e FROM mk) SELECT doc_id, CASE WHEN len(s) > 0 THEN {JOIN.format(_pad('e'))} END AS seq FROM b")
def x06(t):
    return marked(t).select("doc_id", F.array_join(a.pad_last_token(F.col("seq"), N), " ").alias("seq"))


@op("x07_remove_first", f"WITH {MARKED} SELECT doc_id, {JOIN.format(_drop('s', '<D>'))} AS seq FROM mk")
def x07(t):
    return marked(t).select("doc_id", F.array_join(a.remove_first(F.col("seq"), a.DIM), " ").alias("seq"))


@op("x08_loss_mask", f"WITH {MARKED} SELECT doc_id, {JOIN.format('list_transform(s, lambda w: CASE WHEN w <> ' + chr(39) + '<P>' + chr(39) + ' THEN 1 ELSE 0 END)')} AS mask FROM mk")
def x08(t):
    return marked(t).select("doc_id", F.array_join(F.transform(a.loss_mask(F.col("seq")), lambda x: x.cast("int").cast("string")), " ").alias("mask"))


@op("w05_next_token_target", f"WITH {MARKED} SELECT doc_id, {JOIN.format('list_concat(list_slice(s, 2, len(s)), [' + chr(39) + '<P>' + chr(39) + '])')} AS tgt FROM mk")
def w05(t):
    return marked(t).select("doc_id", F.array_join(a.shift_left(F.col("seq")), " ").alias("tgt"))


@op("w07_truncate_at_end", f"WITH {MARKED} SELECT doc_id, {JOIN.format('CASE WHEN list_position(s, ' + chr(39) + '<E>' + chr(39) + ') > 0 THEN list_slice(s, 1, list_position(s, ' + chr(39) + '<E>' + chr(39) + ')) ELSE s END')} AS seq FROM mk")
def w07(t):
    return marked(t).select("doc_id", F.array_join(a.truncate_at(F.col("seq")), " ").alias("seq"))


POSED = f"{MARKED}, ps AS (SELECT doc_id, unnest(s) AS w, unnest(range(1, len(s) + 1)) AS pos FROM mk)"


def posed(t):
    return marked(t).select("doc_id", F.posexplode("seq").alias("p", "w")).select("doc_id", (F.col("p") + 1).cast("long").alias("pos"), (F.col("w") == a.BOS).alias("bos"), (F.col("w") == a.EOS).alias("eos"))


@op("w07_after_end_mask", f"WITH {POSED} SELECT doc_id, pos, coalesce(max(w = '<E>') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS done FROM ps")
def w07m(t):
    return sequence.after_end_mask(posed(t), "doc_id").select("doc_id", "pos", "done")


CLOSED = f"{POSED}, cw AS (SELECT doc_id, pos, w, max(CASE WHEN w = '<S>' THEN pos END) OVER x AS b, max(CASE WHEN w = '<E>' THEN pos END) OVER x AS e FROM ps WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), sg AS (SELECT doc_id, b AS start, pos AS \"end\" FROM cw WHERE w = '<E>' AND b > coalesce(e, -1))"


@op("w06_complete_windows", f"WITH {CLOSED} SELECT * FROM sg")
def w06(t):
    return sequence.complete_windows(posed(t), "doc_id")


@op("x26_apply_to_complete_windows", f"WITH {CLOSED} SELECT ps.doc_id, string_agg(CASE WHEN sg.start IS NOT NULL AND w NOT IN ('<S>', '<E>', '<P>', '<D>') THEN '+' || w ELSE w END, ' ' ORDER BY pos) AS seq FROM ps LEFT JOIN sg ON ps.doc_id = sg.doc_id AND pos BETWEEN start AND \"end\" GROUP BY 1")
def x26(t):
    mark = lambda s: F.transform(s, lambda w: F.when(w.isin(a.BOS, a.EOS, a.PAD, a.DIM), w).otherwise(F.concat(F.lit("+"), w)))
    return marked(t).select("doc_id", F.array_join(sequence.apply_to_complete_windows(F.col("seq"), mark), " ").alias("seq"))


W = 64


@op("x02_pack_separate", f"WITH {DOCS}, w AS (SELECT doc_id, unnest(range(0, (len(tok) + {W - 1}) // {W})) AS wi, tok FROM t), p AS (SELECT doc_id, wi, list_slice(tok, wi * {W} + 1, wi * {W} + {W}) AS s FROM w) SELECT doc_id, wi AS \"window\", md5({JOIN.format(PADS.format('s', 's').replace(str(N), str(W)))}) AS h FROM p")
def x02(t):
    return packing.pack_separate(docs(t), W, "doc_id").select("doc_id", F.col("window").cast("long").alias("window"), shown("seq").alias("h"))


OFFSETS = f"{DOCS}, o AS (SELECT doc_id, tok, md5('42:' || doc_id) AS h, CAST(coalesce(sum(len(tok)) OVER (ORDER BY md5('42:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ FROM t)"


@op("w03_token_offsets", f"WITH {OFFSETS} SELECT doc_id, offset_ AS \"offset\" FROM o")
def w03(t):
    return packing.token_offsets(docs(t), 42, "doc_id").select("doc_id", "offset")


P = 512


@op("x03_pack_concatenated", f"WITH {OFFSETS}, u AS (SELECT offset_ + unnest(range(0, len(tok))) AS g, unnest(tok) AS w FROM o), s AS (SELECT g // {P} AS seq_id, string_agg(w, ' ' ORDER BY g) AS s, count(*) AS n FROM u GROUP BY 1) SELECT seq_id, md5(s || repeat(' <P>', {P} - n)) AS h, n AS n_tokens FROM s")
def x03(t):
    return packing.pack_concatenated(docs(t), P, 42, "doc_id").select("seq_id", shown("seq").alias("h"), F.size(F.filter("seq", lambda x: x != a.PAD)).cast("long").alias("n_tokens"))


@op("x01_chunk_notes", f"WITH {NOTES}, c AS (SELECT *, (row_number() OVER (PARTITION BY piece_id ORDER BY onset, note_id) - 1) // 20 AS slice FROM notes) SELECT piece_id, CAST(slice AS INT) AS slice, count(*) AS n, CAST(sum(pitch) AS BIGINT) AS pitches FROM c GROUP BY 1, 2")
def x01(t):
    return sequence.chunk_notes(notes_view(t("events")), 20).groupBy("piece_id", "slice").agg(F.count("*").alias("n"), F.sum("pitch").alias("pitches"))


LEN, START = U.format(seed="7len", key="doc_id || '/' || v"), U.format(seed="7start", key="doc_id || '/' || v")


@op("x09_two_views", f"WITH {DOCS}, v AS (SELECT doc_id, tok, unnest([0, 1]) AS v FROM t), s AS (SELECT doc_id, v, tok, 10 + {LEN} % 41 AS n, CASE WHEN len(tok) > 10 THEN {START} % (len(tok) - 10 + 1) ELSE 0 END AS st FROM v) SELECT doc_id, v AS view, md5({JOIN.format('list_slice(tok, st + 1, st + n)')}) AS h FROM s")
def x09(t):
    return sequence.two_views(docs(t), "doc_id", 7, 10, 50).select("doc_id", "view", shown("seq").alias("h"))


@op("x10_overlapping_segments", f"WITH {DOCS}, s AS (SELECT doc_id, tok, len(tok) AS n FROM t), k AS (SELECT doc_id, tok, n, unnest(CASE WHEN n > {W} THEN list_distinct(list_concat(range(1, n - {W} + 2, {W}), [n - {W} + 1])) ELSE [1] END) AS st FROM s) SELECT doc_id, st AS start, least(n, {W}) AS weight, md5({JOIN.format(f'list_slice(tok, st, st + {W - 1})')}) AS h FROM k")
def x10(t):
    n = F.size("seq")
    d = docs(t).select("doc_id", "seq", n.alias("n"), F.explode(a.overlapping_segments(F.col("seq"), W)).alias("part"), F.lit(1).alias("one"))
    starts = F.when(n > W, F.array_union(F.sequence(F.lit(1), n - W + 1, F.lit(W)), F.array(n - W + 1))).otherwise(F.array(F.lit(1)))
    d = docs(t).select("doc_id", F.explode(F.arrays_zip(starts.alias("start"), a.overlapping_segments(F.col("seq"), W).alias("part"))).alias("x"))
    return d.select("doc_id", F.col("x.start").cast("long").alias("start"), F.size("x.part").cast("long").alias("weight"), shown("x.part").alias("h"))


STEP = "CAST(round_even(onset / 10.0, 0) AS BIGINT) * 10 AS onset, CAST(round_even(velocity / 10.0, 0) AS BIGINT) * 10 AS velocity, greatest(10, least(100, CAST(round_even(dur / 10.0, 0) AS BIGINT) * 10)) AS dur"
QUANT = f"{NOTES}, qn AS (SELECT piece_id, note_id, pitch, {STEP} FROM notes), qs AS (SELECT *, onset // 86400 AS segment, onset % 86400 AS off FROM qn)"
STEPS = {"time_step": 10, "velocity_step": 10, "max_dur": 100, "segment": 86400}


@op("x24_quantise", f"WITH {QUANT} SELECT note_id, onset, velocity, dur, segment, off AS \"offset\" FROM qs")
def x24(t):
    return sequence.quantise(notes_view(t("events")), **STEPS).select("note_id", "onset", "velocity", "dur", "segment", "offset")


SEQ = f"""{QUANT}, l AS (SELECT *, segment - coalesce(lag(segment) OVER (PARTITION BY piece_id ORDER BY onset, pitch, note_id), 0) AS marks FROM qs),
 sq AS (SELECT piece_id, '<S> ' || string_agg(repeat('<T> ', CAST(marks AS INT)) || 'note:' || pitch || ':' || velocity || ' onset:' || off || ' dur:' || dur, ' ' ORDER BY onset, pitch, note_id) || ' <E>' AS seq FROM l GROUP BY 1)"""


@op("x25_note_tokens", f"WITH {SEQ} SELECT piece_id, md5(seq) AS h, len(string_split(seq, ' ')) AS n FROM sq")
def x25(t):
    return sequence.note_tokens(notes_view(t("events")), **STEPS).select("piece_id", shown("seq").alias("h"), F.size("seq").cast("long").alias("n"))


@op("x25_note_tokens_delta", f"WITH {QUANT}, l AS (SELECT *, onset - coalesce(lag(onset) OVER (PARTITION BY piece_id ORDER BY onset, pitch, note_id), 0) AS wait FROM qs) SELECT piece_id, md5('<S> ' || string_agg('wait:' || wait || ' note:' || pitch || ':' || velocity || ' dur:' || dur, ' ' ORDER BY onset, pitch, note_id) || ' <E>') AS h FROM l GROUP BY 1")
def x25d(t):
    return sequence.note_tokens(notes_view(t("events")), absolute=False, **STEPS).select("piece_id", shown("seq").alias("h"))


FACTOR = f"list_extract([80, 90, 100, 110, 120], 1 + {U.format(seed=9, key='piece_id')} % 5)"


@op("x27_tempo_augment", f"WITH {SEQ}, s AS (SELECT piece_id, {FACTOR} AS f, string_split(seq, ' ') AS s FROM sq), z AS (SELECT piece_id, list_transform(s, lambda w: CASE WHEN w LIKE 'onset:%' OR w LIKE 'dur:%' THEN string_split(w, ':')[1] || ':' || CAST(round_even(CAST(string_split(w, ':')[2] AS BIGINT) * f / 1000.0, 0) AS BIGINT) * 10 ELSE w END) AS s FROM s) SELECT piece_id, md5({JOIN.format('s')}) AS h FROM z")
def x27(t):
    s = sequence.note_tokens(notes_view(t("events")), **STEPS)
    return s.select("piece_id", shown(sequence.tempo_augment(F.col("seq"), F.col("piece_id"), 9)).alias("h"))


@op("o01_global_shuffle", f"SELECT doc_id, {RANK} AS rank FROM documents")
def o01(t):
    return seeded_rank(t("documents").select("doc_id"), 42, "doc_id")


@op("o02_block_shuffle", "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents), b AS (SELECT *, i // 30 AS blk, (i // 30 + 1) * 30 <= count(*) OVER () AS whole FROM d) SELECT doc_id, blk * 30 + row_number() OVER (PARTITION BY blk ORDER BY CASE WHEN whole THEN md5('5:' || i) ELSE '' END, i) - 1 AS rank FROM b")
def o02(t):
    from strophe.sources.records import positional

    return sequence.block_shuffle(positional(t("documents").select("doc_id"), ["doc_id"]), "index", 30, 5).select("doc_id", "rank")


@op("o05_rank_sharded", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42/3:' || doc_id), doc_id) - 1 AS i, count(*) OVER () AS n FROM documents), w AS (SELECT doc_id, i FROM r UNION ALL SELECT doc_id, i + n FROM r WHERE i < (7 - n % 7) % 7) SELECT doc_id, i AS index, i % 7 AS replica FROM w")
def o05(t):
    return sequence.rank_sharded(t("documents").select("doc_id"), "doc_id", 42, 3, 7)


@op("o06_batches_resume", f"WITH r AS (SELECT doc_id, {RANK} AS rank FROM documents), b AS (SELECT doc_id, rank, rank // 32 AS batch FROM r) SELECT doc_id, rank, batch, CASE WHEN batch >= 5 THEN 2 ELSE 1 END AS pass, CASE WHEN batch >= 5 THEN 0 ELSE batch END AS skip FROM b WHERE batch >= 2")
def o06(t):
    d = sequence.batches(seeded_rank(t("documents").select("doc_id"), 42, "doc_id"), "rank", 32, 2)
    p, skip = sequence.resume_point(F.lit(1), F.col("batch"), F.lit(5))
    return d.withColumn("pass", p).withColumn("skip", skip)


@op("o07_merge_tracks", "WITH m AS (SELECT l_suppkey AS piece_id, l_linenumber AS track, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice) AS idx, CAST(l_quantity AS BIGINT) AS delta FROM lineitem), k AS (SELECT *, sum(delta) OVER (PARTITION BY piece_id, track ORDER BY idx) AS tick FROM m) SELECT piece_id, track, CAST(idx AS BIGINT) AS idx, CAST(tick AS BIGINT) AS tick, row_number() OVER (PARTITION BY piece_id ORDER BY tick, track, idx) AS place FROM k")
def o07(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_suppkey", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    m = t("lineitem").select(F.col("l_suppkey").alias("piece_id"), F.col("l_linenumber").alias("track"), F.row_number().over(w).cast("long").alias("idx"), F.col("l_quantity").cast("long").alias("delta"))
    return sequence.merge_tracks(m).select("piece_id", "track", "idx", "tick", F.col("place").cast("long").alias("place"))


@op("o09_exact_split", f"WITH r AS (SELECT doc_id, {RANK} AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN r < floor(n * 0.1) THEN 'eval' ELSE 'train' END AS split FROM r")
def o09(t):
    return sequence.exact_split(t("documents").select("doc_id"), "doc_id", 0.1, 42)


@op("o10_choose_elements", "WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY md5('3:' || conv_id || '/' || turn), turn) AS rn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, rn <= ceil(n * 0.45) AS chosen FROM r")
def o10(t):
    return sequence.choose_elements(t("conversations").select("conv_id", "turn"), "conv_id", "turn", 3)


@op("w08_event_ticks", "WITH e AS (SELECT user_id, event_id, epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id), epoch_us(ts)) AS dt FROM events) SELECT event_id, CAST(round_even(dt * 480 / 500000.0, 0) AS BIGINT) AS ticks FROM e")
def w08(t):
    e = t("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return sequence.event_ticks(e, "user_id", "us", "event_id").select("event_id", "ticks")


@op("h03_composed_transforms", f"WITH {MARKED}, b AS (SELECT doc_id, {_drop('s', '<D>')} AS d FROM mk), e AS (SELECT doc_id, list_filter(d, lambda w: w <> '<P>') AS f FROM b) SELECT doc_id, {JOIN.format('f')} AS seq FROM e")
def h03(t):
    from functools import reduce

    steps = [lambda s: a.remove_first(s, a.DIM), lambda s: F.filter(s, lambda x: x != a.PAD)]
    return marked(t).select("doc_id", F.array_join(reduce(lambda s, f: f(s), steps, F.col("seq")), " ").alias("seq"))


@op("h02_tokenise_callback", r"WITH w AS (SELECT doc_id, regexp_split_to_array(trim(text, ' '), '\s+') AS tok FROM documents) SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE len(tok) END AS n, doc_id % 11 = 0 AS failed FROM w")
def h02(t):
    from strophe.operators.embed import tokenise

    d = tokenise(t("documents").select("doc_id", "text"), _words_or_fail)
    return d.select("doc_id", F.size("seq").cast("long").alias("n"), F.col("error").isNotNull().alias("failed")).withColumn("n", F.when(~F.col("failed"), F.col("n")))


def _words_or_fail(row: dict) -> list[str]:
    """A tokeniser that fails on some records, to show that these are passed on as failed."""
    import re

    if row["doc_id"] % 11 == 0:
        raise ValueError("no")
    return re.split(r"\s+", row["text"].strip(" "))


