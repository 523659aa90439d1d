"""Tool-call linking for chat data, in DataFrame functions alone.

Calls are hash-joined with results by (conversation, call id), set in topological order of their dependencies, validated
against parameter schemas, and written as canonical JSON: keys in order, no white space, nested values included.

``level`` is the length of the longest chain of calls before a call. Calls with one dependency are settled by pointer doubling:
each points to the call it follows, then to the one that follows in turn, twice as far a round, until it meets a call without a
dependency or with several; a chain of n calls takes log2 n joins. Calls with several dependencies are then sorted by Kahn's
method over what is left, one join for each level of such calls.

Defined results: a call without a result -> status 'no result', a result without a call -> its own row, 'no call'; arguments
that are null or no JSON object -> status 'bad arguments'; unknown tool, missing, unknown or wrongly typed parameters are
listed in ``problems`` ('invalid'); dependencies on calls that are not there are ignored; calls on or behind a cycle have a
null level ('cycle'). Of rows with one id the least (turn, name, arguments or content) counts; ``copies`` and ``result_copies`` say
how many there were; null ids are dropped; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strophe.llm.common import materialise, work_dir

KEYS = ["conv_id", "call_id"]
#: Schema type -> the variant types that count as it.
TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"], "boolean": ["BOOLEAN"], "object": ["OBJECT"], "array": ["ARRAY"]}
MAX_SCHEMAS = 10_000
#: Characters of a turn that waits for the next (from_conversations).
SHORT = 40


def levels(calls: DataFrame, folder: str) -> DataFrame:
    """(conv_id, call_id, level); calls on or behind a cycle are left out."""
    known = calls.select("conv_id", F.col("call_id").alias("before"))
    edges = calls.select(*KEYS, F.explode(F.array_distinct("after")).alias("before")).join(known.hint("shuffle_hash"), ["conv_id", "before"])
    edges = materialise(edges.select(*KEYS, "before"), folder, "edges")
    needs = materialise(edges.groupBy(*KEYS).agg(F.count("*").alias("needs"), F.min("before").alias("before")), folder, "needs")
    roots = calls.select(*KEYS).join(needs.hint("shuffle_hash"), KEYS, "left_anti").withColumn("level", F.lit(0).cast("long"))
    most = calls.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0  # one number
    chained = jumps(needs, most, folder)
    # where a call's level comes from: a merge (a call of several dependencies) and the steps from it; no merge: the steps are the level
    merges = needs.where("needs > 1").select(*KEYS)
    if merges.isEmpty():
        return roots.unionByName(chained.where("merge is null").select(*KEYS, F.col("steps").alias("level")))
    source = roots.select(*KEYS, F.lit(None).cast("string").alias("merge"), F.col("level").alias("steps"))
    source = source.unionByName(chained).unionByName(merges.select(*KEYS, F.col("call_id").alias("merge"), F.lit(0).cast("long").alias("steps")))
    to_merges = edges.join(merges.hint("shuffle_hash"), KEYS)
    to_merges = to_merges.join(source.withColumnRenamed("call_id", "before").hint("shuffle_hash"), ["conv_id", "before"], "left")
    # a dependency without a source lies on or behind a cycle of single calls: it waits for itself, forever
    to_merges = to_merges.select(*KEYS, F.when(F.col("steps").isNull(), F.col("before")).otherwise(F.col("merge")).alias("merge"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    settled = kahn(merges, materialise(to_merges, folder, "to_merges"), folder)
    behind = chained.where("merge is not null").join(settled.select("conv_id", F.col("call_id").alias("merge"), "level").hint("shuffle_hash"), ["conv_id", "merge"])
    return roots.unionByName(chained.where("merge is null").select(*KEYS, F.col("steps").alias("level"))).unionByName(settled).unionByName(behind.select(*KEYS, (F.col("level") + F.col("steps")).alias("level")))


def jumps(needs: DataFrame, most: int, folder: str) -> DataFrame:
    """(conv_id, call_id, merge, steps) of the calls with one dependency: the steps back to a merge, or (null) to a call without
    any. Calls whose chain runs into a cycle of such calls are left out: they still have a way to go after ``most`` steps."""
    kinds = needs.select("conv_id", F.col("call_id").alias("at"), (F.col("needs") == 1).alias("single"))
    now = needs.where("needs = 1").select(*KEYS, F.col("before").alias("at")).join(kinds.hint("shuffle_hash"), ["conv_id", "at"], "left")
    # open: the call pointed to has one dependency itself
    now = now.select(*KEYS, "at", F.lit(1).cast("long").alias("steps"), F.coalesce("single", F.lit(False)).alias("open"), F.col("single").isNotNull().alias("is_merge"))
    now, reach, i = materialise(now, folder, "jumps_0"), 1, 0
    while reach <= most and not now.where("open").isEmpty():
        on = now.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("open").alias("next_open"), F.col("is_merge").alias("next_merge"))
        further = now.where("open").drop("is_merge").join(on.hint("shuffle_hash"), ["conv_id", "at"])
        further = further.select(*KEYS, F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("next_open").alias("open"), F.col("next_merge").alias("is_merge"))
        reach, i = 2 * reach, i + 1
        now = materialise(now.where("not open").unionByName(further), folder, f"jumps_{i}")
    return now.where("not open").select(*KEYS, F.when(F.col("is_merge"), F.col("at")).alias("merge"), "steps")


def kahn(merges: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """Levels of merges; edges (conv_id, call_id, merge or null, steps). Each round settles the calls that wait for no merge,
    and joins them with the edges that wait; settled calls and edges are not read again."""
    unsettled, waiting, out = edges.where("merge is null").groupBy(*KEYS).agg(F.max("steps").alias("level")), edges.where("merge is not null"), []
    for i in range(1_000_000):
        late = waiting.select(*KEYS).distinct()
        free = materialise(unsettled.join(late.hint("shuffle_hash"), KEYS, "left_anti"), folder, f"settled_{i}")
        if free.isEmpty():
            break
        out.append(free)
        have = free.select("conv_id", F.col("call_id").alias("merge"), "level")
        met = waiting.join(have.hint("shuffle_hash"), ["conv_id", "merge"]).groupBy(*KEYS).agg(F.max(F.col("level") + F.col("steps")).alias("level"))
        left = unsettled.join(free.select(*KEYS).hint("shuffle_hash"), KEYS, "left_anti").unionByName(met)
        unsettled = materialise(left.groupBy(*KEYS).agg(F.max("level").alias("level")), folder, f"unsettled_{i}")
        waiting = materialise(waiting.join(have.hint("shuffle_hash"), ["conv_id", "merge"], "left_anti").select(*KEYS, "merge", "steps"), folder, f"waiting_{i}")
    return reduce(DataFrame.unionByName, out) if out else merges.limit(0).withColumn("level", F.lit(0).cast("long"))


def _type_problem(kind: Column, wanted: Column) -> Column:
    found = F.regexp_extract(kind, "^[A-Z]+", 0)
    fits = F.lit(False)
    for name, kinds in TYPES.items():
        fits = fits | ((wanted == name) & found.isin(kinds))
    return ~fits


def problems(arguments: Column, params: Column) -> Column:
    """What speaks against arguments (map<string, variant>); params: array<struct<name, type, required>>, null if the tool is unknown."""
    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.coalesce(F.map_contains_key(arguments, p["name"]), F.lit(False))), lambda p: F.concat(F.lit("missing "), p["name"]))
    names = F.transform(params, lambda p: p["name"])
    unknown = F.transform(F.filter(F.map_keys(arguments), lambda k: ~F.array_contains(names, k)), lambda k: F.concat(F.lit("unknown "), k))
    typed = F.filter(params, lambda p: F.coalesce(F.map_contains_key(arguments, p["name"]), F.lit(False)))
    wrong = F.transform(F.filter(typed, lambda p: _type_problem(F.schema_of_variant(F.try_element_at(arguments, p["name"])), p["type"])), lambda p: F.concat(F.lit("not "), p["type"], F.lit(" "), p["name"]))
    return F.when(params.isNull(), F.array(F.lit("unknown tool"))).otherwise(F.array_sort(F.concat(missing, unknown, wrong)))


def link(calls: DataFrame, results: DataFrame, schemas: list[tuple[str, list[tuple[str, str, bool]]]]) -> DataFrame:
    """calls(conv_id, call_id, turn, name, arguments, after), results(conv_id, call_id, content)."""
    if len(schemas) > MAX_SCHEMAS:
        raise ValueError(f"at most {MAX_SCHEMAS} schemas")
    spark = calls.sparkSession
    folder = work_dir(spark, "tool_calls")
    one = calls.where("conv_id is not null and call_id is not null").groupBy(*KEYS).agg(F.min(F.struct("turn", "name", "arguments", "after")).alias("c"), F.count("*").alias("copies"))
    one = materialise(one.select(*KEYS, "c.*", "copies"), folder, "calls")
    answers = results.where("conv_id is not null and call_id is not null").groupBy(*KEYS).agg(F.min("content").alias("content"), F.count("*").alias("result_copies"))
    tools = spark.createDataFrame(schemas, "name string, params array<struct<name: string, type: string, required: boolean>>")
    parsed = F.try_parse_json(F.col("arguments"))
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    own = one.join(levels(one, folder).hint("shuffle_hash"), KEYS, "left").join(F.broadcast(tools), "name", "left")
    own = own.withColumn("values", F.when(is_object, F.from_json("arguments", "map<string, variant>"))).withColumn("canonical", F.when(is_object, F.to_json(parsed)))
    both = own.withColumn("is_call", F.lit(True)).join(answers.hint("shuffle_hash"), KEYS, "full")
    bad = F.col("values").isNull()
    found = F.when(F.col("is_call") & ~bad, problems(F.col("values"), F.col("params")))
    both = both.withColumn("problems", F.coalesce(found, F.array().cast("array<string>")))
    status = (
        F.when(F.col("is_call").isNull(), "no call").when(bad, "bad arguments").when(F.size("problems") > 0, "invalid")
        .when(F.col("level").isNull(), "cycle").when(F.col("result_copies").isNull(), "no result").otherwise("linked")
    )
    text = lambda c: F.coalesce(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("v")))).substr(F.lit(6), F.length(F.to_json(F.to_variant_object(F.struct(F.col(c).alias("v"))))) - 6), F.lit("null"))
    line = F.concat(
        F.lit('{"arguments":'), F.coalesce("canonical", F.lit("null")), F.lit(',"call_id":'), text("call_id"), F.lit(',"level":'), F.coalesce(F.col("level").cast("string"), F.lit("null")),
        F.lit(',"name":'), text("name"), F.lit(',"result":'), text("content"), F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null")), F.lit("}"),
    )
    return both.select(*KEYS, "turn", "name", "level", status.alias("status"), F.array_join("problems", "; ").alias("problems"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), F.coalesce("result_copies", F.lit(0)).cast("long").alias("result_copies"), line.alias("json"))


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """Calls, results and schemas of a plain conversation table.

    Each turn but an assistant's is a call: of 'configure' (system), 'reply' (user) or the role itself, which no schema knows. An
    assistant's turn is the result of the call one turn before. Arguments are pasted together as text, so that a line break or
    quote in a turn makes bad JSON; 'detail', what follows a turn's first comma, is missing where there is none. A call follows
    the calls of the two turns before it, or, with a text of under SHORT characters, the call two turns later.
    """
    named = lambda t: F.concat_ws(":", F.lit("call"), F.col("conv_id"), t)
    turn, text = F.col("turn"), F.col("text")
    name = F.when(F.col("role") == "system", "configure").when(F.col("role") == "user", "reply").otherwise(F.col("role"))
    quoted = lambda key, value: F.concat(F.lit(f'"{key}":"'), value, F.lit('"'))
    detail = F.when((name == "reply") & (F.instr(text, ",") > 0), quoted("detail", F.substr(text, F.instr(text, ",") + 1)))
    fields = [F.concat(F.lit('"n_chars":'), F.length(text)), detail, quoted("prompt", text), F.concat(F.lit('"turn":'), turn)]
    arguments = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    after = F.when(F.length(text) < SHORT, F.array(named(turn + 2))).otherwise(F.array(named(turn - 2), named(turn - 1)))
    calls = turns.where("coalesce(role, '') <> 'assistant'").select("conv_id", named(turn).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", named(turn - 1).alias("call_id"), F.col("text").alias("content"))
    params = [("turn", "integer", True), ("prompt", "string", True), ("n_chars", "integer", False)]
    return calls, results, [("reply", [*params, ("detail", "string", True)]), ("configure", params)]
