"""Text patches over conversations (a line for each turn) and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strophe.operators import patches as p
from strophe.queries import op
from strophe.queries.corpus import TOKENS, U

ASCII = f"replace(translate({{}}, '{p.FROM}', '{p.TO}'), 'ß', 'ss')"


@op("x18_transliterate", f"SELECT doc_id, md5({ASCII.format('text')}) AS h FROM documents")
def x18(t):
    return t("documents").select("doc_id", F.md5(p.transliterate(F.col("text"))).alias("h"))


@op("x13_text_to_ids", f"WITH x AS (SELECT conv_id, turn, regexp_replace({ASCII.format('text')}, '[^ -~]', '', 'g') AS s FROM conversations), c AS (SELECT conv_id, turn, s, list_slice(list_concat([1], list_transform(string_split(s, ''), lambda c: ascii(c)), [2]), 1, 64) AS i FROM x), f AS (SELECT *, list_concat(i, list_transform(range(0, 64 - len(i)), lambda z: 0)) AS ids FROM c) SELECT conv_id, turn, array_to_string(ids, ',') AS ids, substr(s, 1, 63) AS back FROM f")
def x13(t):
    s = F.regexp_replace(p.transliterate(F.col("text")), "[^ -~]", "")
    d = t("conversations").select("conv_id", "turn", p.to_ids(s).alias("ids"))
    return d.select("conv_id", "turn", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), p.from_ids(F.col("ids")).alias("back"))


ROLE_IDS = "array_to_string(list_concat([1], list_transform(string_split(role, ''), lambda c: ascii(c)), [2], list_transform(range(0, 62 - length(role)), lambda z: 0)), ',')"


@op("x14_boundary_patches", f"SELECT conv_id, count(*) + 2 AS n, md5(repeat('1,', 63) || '1;' || string_agg({ROLE_IDS}, ';' ORDER BY turn, {ROLE_IDS}) || ';1' || repeat(',2', 63)) AS patches FROM conversations GROUP BY 1")
def x14(t):
    rows = t("conversations").select("conv_id", F.struct("turn", p.to_ids(F.col("role")).alias("ids")).alias("r"))
    d = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("r")).alias("rs")).withColumn("ps", p.with_boundaries(F.transform("rs", lambda r: r["ids"])))
    shown = F.array_join(F.transform("ps", lambda q: F.array_join(F.transform(q, lambda x: x.cast("string")), ",")), ";")
    return d.select("conv_id", F.size("ps").cast("long").alias("n"), F.md5(shown).alias("patches"))


LINES = r"ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS idx FROM documents)"


@op("x17_message_text", "WITH l AS (SELECT conv_id, turn, replace(replace(replace(replace(role || ' ' || turn || ' ' || text, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS line FROM conversations) SELECT conv_id, md5('ticks_per_beat 480' || chr(10) || string_agg(line, chr(10) ORDER BY turn)) AS h FROM l GROUP BY 1")
def x17(t):
    lines = t("conversations").select("conv_id", "turn", p.message_line(F.col("role"), F.col("turn").cast("string"), F.col("text")).alias("line"))
    return p.message_text(lines, "conv_id", "turn").select("conv_id", F.md5("text").alias("h"))


#: The digest of a list of patches: md5 of the digest so far and the next patch, from an empty one on.
GROUPED = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_extract_all(text, '([^\\n]*\\n|[^\\n]+$)', 1), lambda s: s <> '') AS ls FROM documents),
 g AS (SELECT doc_id, ls, 1 AS i, CASE WHEN starts_with(ls[1], ' ') AND length(ls[1]) <= 255 THEN chr(9) || substr(ls[1], 2) ELSE ls[1] END AS open, 0 AS done, '' AS h FROM w WHERE len(ls) > 0 UNION ALL
 SELECT doc_id, ls, i + 1, CASE WHEN j THEN open[1:length(open) - 1] || chr(9) || rest ELSE nxt END, done + (NOT j)::INT, CASE WHEN j THEN h ELSE md5(h || open) END FROM (SELECT doc_id, ls, i, open, done, h, ls[i + 1] AS nxt, CASE WHEN contains(ls[i + 1], ' ') THEN substr(ls[i + 1], instr(ls[i + 1], ' ') + 1) ELSE '' END AS rest,
 starts_with(open, string_split(ls[i + 1], ' ')[1]) AND length(open) + length(CASE WHEN contains(ls[i + 1], ' ') THEN substr(ls[i + 1], instr(ls[i + 1], ' ') + 1) ELSE '' END) <= 254 AS j FROM g WHERE i < len(ls)))
 SELECT doc_id, done + 1 AS n_patches, md5(h || open) AS patches FROM g WHERE i = len(ls)"""


def chained(ps):
    return F.aggregate(ps, F.lit(""), lambda h, p: F.md5(F.concat(h, p)))


@op("x11_group_lines", GROUPED)
def x11(t):
    d = t("documents").select("doc_id", p.group_lines(p.lines_of(F.col("text")), 256).alias("ps")).where("size(ps) > 0")
    return d.select("doc_id", F.size("ps").alias("n_patches"), chained(F.col("ps")).alias("patches"))


@op("x11_group_lines_in_python", GROUPED)
def x11p(t):
    d = p.group_lines_in_python(t("documents").select("doc_id", p.lines_of(F.col("text")).alias("ls")), "ls", "ps", 256).where("size(ps) > 0")
    return d.select("doc_id", F.size("ps").alias("n_patches"), chained(F.col("ps")).alias("patches"))


@op("x12_bar_patches", r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS idx FROM documents), q AS (SELECT doc_id, idx, line, list_filter(string_split(regexp_replace(line, '(\|:|::|:\||\[\||\|\||\|\]|\|)', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS b FROM l), h AS (SELECT doc_id, CASE WHEN regexp_matches(line, '^\p{L}:') OR starts_with(line, '%%') THEN 1 ELSE (len(b) - CASE WHEN len(b) > 1 AND b[1] IN ('|:', '::', ':|', '[|', '||', '|]', '|') THEN 1 ELSE 0 END) // 2 END AS n FROM q) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_patches FROM h GROUP BY 1")
def x12(t):
    return t("documents").select("doc_id", F.size(p.bar_patches(F.col("text"))).cast("long").alias("n_patches"))


CHOICE, START = U.format(seed="4choice", key="doc_id"), U.format(seed="4start", key="doc_id")


@op("x15_truncate", rf"WITH t AS (SELECT doc_id, {TOKENS} AS w FROM documents), s AS (SELECT doc_id, w, len(w) AS n, CASE {CHOICE} % 3 WHEN 0 THEN 0 WHEN 1 THEN len(w) - 50 ELSE 1 + {START} % greatest(len(w) - 50, 1) END AS st FROM t) SELECT doc_id, md5(array_to_string(CASE WHEN n > 50 THEN list_slice(w, st + 1, st + 50) ELSE w END, ' ')) AS h FROM s")
def x15(t):
    from strophe.functions.arrays import tokens_of

    return t("documents").select("doc_id", F.md5(F.array_join(p.truncate(tokens_of(F.col("text")), 50, 4, F.col("doc_id")), " ")).alias("h"))


@op("x16_strip_instruments", "WITH l AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'ticks_per_beat 480' || chr(10) || 'program_change 3 0 ' || turn || chr(10) || 'note_on 1' ELSE 'V:1 clef nm=\"' || role || '\" snm=\"x\"' || chr(10) || 'CDEF|' END AS s FROM conversations) SELECT conv_id, turn, CASE WHEN starts_with(s, 'ticks') THEN 'ticks_per_beat 480' || chr(10) || 'program_change 3 0 0' || chr(10) || 'note_on 1' ELSE 'V:1 clef' || chr(10) || 'CDEF|' END AS s FROM l")
def x16(t):
    message = F.concat(F.lit("ticks_per_beat 480\nprogram_change 3 0 "), F.col("turn").cast("string"), F.lit("\nnote_on 1"))
    voice = F.concat(F.lit('V:1 clef nm="'), F.col("role"), F.lit('" snm="x"\nCDEF|'))
    d = t("conversations").withColumn("s", F.when(F.col("role") == "system", message).otherwise(voice))
    return d.select("conv_id", "turn", p.strip_instruments(F.col("s")).alias("s"))


CELLS = "list_concat([1], list_transform(string_split(role, ''), lambda c: ascii(c)), [2], [0, 0, 0])"
PICK = f"{U.format(seed='6choice', key='conv_id')} % 10"


@op("x28_corrupt", f"""WITH c AS (SELECT conv_id, turn, {CELLS} AS ids, turn % 2 = 0 AS chosen, {PICK} AS d FROM conversations), i AS (SELECT conv_id, turn, unnest(ids) AS x, unnest(range(0, len(ids))) AS k, list_position(ids, 2) AS e FROM c),
 m AS (SELECT conv_id, turn, string_agg(CAST(x AS VARCHAR), ',' ORDER BY CASE WHEN k = 0 THEN 0 WHEN k < e - 1 THEN 1 ELSE 2 END, CASE WHEN k > 0 AND k < e - 1 THEN md5('6:' || conv_id || '/' || turn || '/' || (k - 1)) END, k) AS s FROM i GROUP BY 1, 2)
 SELECT conv_id, turn, CASE WHEN chosen AND d < 8 THEN array_to_string(list_transform(ids, lambda z: 3), ',') WHEN chosen AND d = 8 THEN s ELSE array_to_string(ids, ',') END AS patch FROM c JOIN m USING (conv_id, turn)""")
def x28(t):
    codes = F.transform(F.split("role", ""), lambda c: F.ascii(c))
    cells = t("conversations").select("conv_id", "turn", F.concat(F.array(F.lit(1)), codes, F.array(*(F.lit(x) for x in (2, 0, 0, 0)))).alias("patch"), (F.col("turn") % 2 == 0).alias("chosen"))
    return p.corrupt(cells, "conv_id", "turn", "chosen", 6).select("conv_id", "turn", F.array_join(F.transform("patch", lambda x: x.cast("string")), ",").alias("patch"))
