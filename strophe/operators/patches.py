"""Text patches of symbolic music: lines, bars, fixed-width integer patches, truncation and corruption.

Fixed values: the bar delimiters, the ids of pad, begin, end and mask, the patch width and the patch count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.functions.hashing import hash_int, hash_key

DELIMITERS = ["|:", "::", ":|", "[|", "||", "|]", "|"]
PAD_ID, BOS_ID, EOS_ID, MASK_ID = 0, 1, 2, 3
PATCH_SIZE, PATCH_LENGTH = 64, 512
#: Accented Latin letters -> ASCII (a subset of transliteration).
FROM, TO = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ", "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def transliterate(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, FROM, TO), "ß", "ss")


def lines_of(text: Column) -> Column:
    """Lines with their line breaks; no empty last one."""
    return F.regexp_extract_all(text, F.lit(r"([^\n]*\n|[^\n]+$)"), F.lit(1))


def group_lines(lines: Column, size: int = PATCH_SIZE) -> Column:
    """Greedy grouping: a line joins the open patch if the patch starts with the line's first word and the rest fits in size - 2;
    then the patch's last character gives way to a tab and the rest. A fold that carries the open patch. It runs over blocks of
    some sqrt(n) lines, so that closing a patch copies the patches of its block only, and closing a block those before it: n lines
    cost n * sqrt(n) references in place of n squared."""
    empty = F.array().cast("array<string>")

    def turn(s: Column, line: Column) -> Column:
        word = F.substring_index(line, " ", 1)
        rest = F.when(F.instr(line, " ") > 0, F.substr(line, F.instr(line, " ") + 1)).otherwise("")
        joins = F.startswith(s["open"], word) & (F.length(s["open"]) + F.length(rest) <= size - 2)
        joined = F.concat(F.substr(s["open"], F.lit(1), F.greatest(F.length(s["open"]) - 1, F.lit(0))), F.lit("\t"), rest)
        closed = F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
        return F.struct(F.when(joins, s["done"]).otherwise(closed).alias("done"), F.when(joins, joined).otherwise(line).alias("open"))

    def block(s: Column, own: Column) -> Column:
        start = F.struct(empty.alias("done"), s["open"].alias("open"))
        return F.aggregate(own, start, turn, lambda r: F.struct(F.concat(s["done"], r["done"]).alias("done"), r["open"].alias("open")))

    def grouped(own: Column) -> Column:
        side = F.greatest(F.ceil(F.sqrt(F.size(own))).cast("int"), F.lit(1))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), side), lambda i: F.slice(own, i, side))
        begun = F.struct(empty.alias("done"), F.lit("").alias("open"))
        return F.aggregate(blocks, begun, block, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))

    # bound by an outer transform, so that the lines are made once
    return F.transform(F.array(lines), grouped)[0]


def group_lines_in_python(df: DataFrame, column: str, out: str, size: int = PATCH_SIZE) -> DataFrame:
    """The same, linear in the number of lines."""
    from strophe.operators.embed import tokenise

    def fold(row: dict) -> list[str]:
        done: list[str] = []
        patch = ""
        for line in row[column]:
            word, _, rest = line.partition(" ")
            if patch.startswith(word) and len(patch) + len(rest) <= size - 2:
                patch = f"{patch[:-1]}\t{rest}"
            else:
                if patch:
                    done.append(patch)
                patch = line
        return [*done, patch] if patch else done

    return tokenise(df, fold, strict=True).withColumnRenamed("seq", out).drop("error")


def bound(value: Column, f) -> Column:
    """f(value), where value is computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def split_bars(line: Column) -> Column:
    """Bars with their closing delimiters: a leading delimiter goes to the next part, parts pair up, an odd last one is dropped."""
    mark = "(" + "|".join("".join("\\" + ch for ch in d) for d in DELIMITERS) + ")"
    parts = F.filter(F.split(F.regexp_replace(line, mark, "\u0001$1\u0001"), "\u0001"), lambda x: x != "")

    def paired(p: Column) -> Column:
        # parts left out after a leading delimiter's own: the first bar is then parts 1 to 3, and all others begin one part later
        skip = F.when(F.get(p, F.lit(0)).isin(DELIMITERS) & (F.size(p) > 1), 1).otherwise(0)
        half = F.floor((F.size(p) - skip) / 2).cast("int")

        def bar(i: Column) -> Column:
            own = F.concat(F.get(p, i * 2 + skip), F.get(p, i * 2 + skip + 1))
            return F.when((i == 0) & (skip == 1), F.concat(p[0], own)).otherwise(own)

        return F.when(half > 0, F.transform(F.sequence(F.lit(0), half - 1), bar)).otherwise(F.array().cast("array<string>"))

    return bound(parts, paired)


def bar_patches(text: Column) -> Column:
    """Patches of a bar notation: 'L:1/8' lines go first, header lines stay whole, the others are split in bars, the last with a
    line break."""
    def of(line: Column) -> Column:
        header = line.rlike(r"^\p{L}:") | F.startswith(line, F.lit("%%"))
        closed = lambda bars: F.when(F.size(bars) > 0, F.concat(F.slice(bars, F.lit(1), F.size(bars) - 1), F.array(F.concat(F.element_at(bars, -1), F.lit("\n"))))).otherwise(bars)
        return F.when(header, F.array(line)).otherwise(bound(split_bars(line), closed))

    return F.flatten(F.transform(lines_of(F.replace(text, F.lit("L:1/8\n"), F.lit(""))), of))


def to_ids(patch: Column, size: int = PATCH_SIZE) -> Column:
    """begin + character codes + end, cut and padded to size."""
    codes = F.transform(F.filter(F.split(patch, ""), lambda c: c != ""), lambda c: F.ascii(c))
    full = F.slice(F.concat(F.array(F.lit(BOS_ID)), codes, F.array(F.lit(EOS_ID))), 1, size)
    return F.concat(full, F.array_repeat(F.lit(PAD_ID), F.greatest(F.lit(0), F.lit(size) - F.size(full)).cast("int")))


def from_ids(ids: Column) -> Column:
    """Text of a patch: ids up to the mask's are dropped."""
    return F.array_join(F.transform(F.filter(ids, lambda i: i > MASK_ID), lambda i: F.chr(i)), "")


def with_boundaries(patches: Column, size: int = PATCH_SIZE) -> Column:
    """Integer patches with one before them of begin ids, and one after them of a begin and end ids."""
    first = F.array_repeat(F.lit(BOS_ID), size)
    last = F.concat(F.array(F.lit(BOS_ID)), F.array_repeat(F.lit(EOS_ID), size - 1))
    return F.concat(F.array(first), patches, F.array(last))


def truncate(patches: Column, n: int = PATCH_LENGTH, seed=None, key: Column | None = None) -> Column:
    """At most n patches: the head, or with a seed head, tail or middle by hash; a middle starts at 1 to size - n."""
    size = F.size(patches)
    if seed is None:
        return F.slice(patches, 1, n)
    choice = F.pmod(hash_int(f"{seed}choice", key), F.lit(3))
    start = F.when(choice == 0, 0).when(choice == 1, size - n).otherwise(1 + F.pmod(hash_int(f"{seed}start", key), F.greatest(size - n, F.lit(1)))).cast("int")
    return F.when(size > n, F.slice(patches, start + 1, F.lit(n))).otherwise(patches)


def message_line(*values: Column) -> Column:
    """Values joined by a space, with backslashes, line breaks, carriage returns and tabs escaped."""
    out = F.concat_ws(" ", *values)
    for a, b in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def message_text(lines: DataFrame, key: str, order: str, ticks_per_beat: int = 480) -> DataFrame:
    """(key, text): 'ticks_per_beat N', then the piece's lines in order."""
    d = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("x"))
    return d.select(key, F.array_join(F.concat(F.array(F.lit(f"ticks_per_beat {ticks_per_beat}")), F.transform("x", lambda s: s["line"])), "\n").alias("text"))


def strip_instruments(text: Column) -> Column:
    """Message texts: the last field of program_change lines becomes 0. Others: 'V:' lines are cut at ' nm=', else at ' snm='."""
    def message(line: Column) -> Column:
        return F.when(F.startswith(line, F.lit("program_change")), F.concat(F.regexp_replace(line, r" [^ ]*$", ""), F.lit(" 0\n"))).otherwise(line)

    def voice(line: Column) -> Column:
        cut = F.when(F.instr(line, " nm=") > 0, F.instr(line, " nm=")).otherwise(F.instr(line, " snm="))
        return F.when(F.startswith(line, F.lit("V:")) & (cut > 0), F.concat(F.substr(line, F.lit(1), cut - 1), F.lit("\n"))).otherwise(line)

    is_message = F.substring_index(F.regexp_extract(text, r"^[^\n]*", 0), " ", 1) == "ticks_per_beat"
    return F.array_join(F.when(is_message, F.transform(lines_of(text), message)).otherwise(F.transform(lines_of(text), voice)), "")


def corrupt(cells: DataFrame, key: str, pos: str, chosen: str, seed, evaluate: bool = False) -> DataFrame:
    """cells(key, pos, patch ids, chosen boolean): the chosen patches of a piece are masked (0.8), shuffled (0.1) or kept (0.1) by the
    piece's hash; shuffled: cells between the first and the end id, in hash order. Evaluation keeps all."""
    if evaluate:
        return cells
    draw = F.pmod(hash_int(f"{seed}choice", F.col(key)), F.lit(10))
    eos = F.array_position("patch", EOS_ID).cast("int")
    inner = F.when(eos > 0, F.slice("patch", F.lit(2), F.greatest(eos - 2, F.lit(0)))).otherwise(F.slice("patch", F.lit(2), F.size("patch")))
    tail = F.when(eos > 0, F.slice("patch", eos, F.size("patch"))).otherwise(F.array().cast("array<int>"))
    place = lambda i: hash_key(seed, F.concat_ws("/", F.col(key).cast("string"), F.col(pos).cast("string"), i.cast("string")))
    mixed = F.transform(F.array_sort(F.transform(inner, lambda x, i: F.struct(place(i).alias("h"), x.alias("x")))), lambda s: s["x"])
    shuffled = F.concat(F.slice("patch", 1, 1), mixed, tail)
    masked = F.array_repeat(F.lit(MASK_ID), F.size("patch"))
    return cells.withColumn("patch", F.when(F.col(chosen) & (draw < 8), masked).when(F.col(chosen) & (draw == 8), shuffled).otherwise(F.col("patch")))
