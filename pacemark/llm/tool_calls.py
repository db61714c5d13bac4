"""Linking of tool calls and results: hash join by identifier, topological order, schema checks, canonical JSON.

Calls carry a conversation, an identifier, a turn, a tool, arguments as JSON text and the
identifiers they depend on; results a conversation, an identifier, a turn and content.

* Of several calls with one identifier the earliest (turn, then tool and arguments) counts, the others come out as
  ``duplicate`` with their own turn, tool and record; likewise for results, where later ones are ``repeated``.
* The level of a call is the length of its longest chain of dependencies. Chains of calls with one
  dependency are shortened by pointer doubling, so a chain of any length costs a logarithmic number
  of rounds. Calls with several dependencies are dealt into blocks of neighbouring turns; a task
  settles a block, and a further round is needed only where chains cross blocks. Calls on a cycle, or
  behind one, have no level and are ``cyclic``. Dependencies that name no call count for nothing.
* The position of a call in its conversation follows level, turn and identifier. It is taken from
  one range-partitioned order of all calls, so a conversation of any size needs no single task.
* Arguments are checked against the schema of the tool (name, type and need of each parameter).
* The record is JSON with sorted keys and no spaces, the same for equal content: a number with no fraction is written
  without one, and half of a surrogate pair as its escape. ``NaN`` and infinities are not JSON; a number beyond doubles is
  ``number too large``. In both cases the record holds the arguments as text.

Status of calls: ``duplicate``, ``no_id``, ``cyclic``, ``invalid``, ``unanswered`` or ``ok``, the first that applies. Every
result comes out once too: with its call, as ``repeated``, or as ``orphan`` where it has no call or no identifier. Calls
without conversation or identifier are linked with nothing. Empty tables give no rows. Other columns of the inputs are
ignored. Texts of any length are checked whole, one row at a time.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pacemark.session import written

_AT = ["conv_id", "call_id"]
#: Calls with several dependencies that one task settles together.
BLOCK_CALLS = 20_000


def first_of_each(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The row of every identifier that is first in ``order``, and all other rows, those without identifier included."""
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    first = (numbered.where("conv_id IS NOT NULL AND call_id IS NOT NULL").groupBy(*_AT)
             .agg(F.min(F.struct(*order, "row")).alias("c")).select(*_AT, "c.*"))
    return first.drop("row"), numbered.join(first.select("row"), "row", "left_anti").drop("row")


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank``, from 0, in one range-partitioned order of all rows."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = written(ordered.withColumn("id", F.monotonically_increasing_id()), "order")
    part, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    marked = marked.withColumns({"part": part, "place": place})
    # one row per partition
    sizes = marked.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)),
                                             F.lit(0)).alias("before"))
    return marked.join(before, "part").select(*rows.columns, (F.col("before") + F.col("place")).alias("rank"))


def _settle_block(got: pa.Table) -> pa.Table:
    """Bases of the nodes of a block whose dependencies are all known, inside it or by ``n`` and ``value`` from outside."""
    names = list(zip(got["conv_id"].to_pylist(), got["node"].to_pylist()))
    place = {name: i for i, name in enumerate(names)}
    missing = (got["k"].to_numpy() - got["n"].to_numpy()).tolist()
    base = got["value"].to_pylist()
    followers: list[list[tuple[int, int]]] = [[] for _ in names]
    for i, inner in enumerate(got["inner"].to_pylist()):
        for dep in inner or ():
            followers[place[names[i][0], dep["end"]]].append((i, dep["steps"]))
    ready = [i for i, m in enumerate(missing) if m == 0]
    for i in ready:
        for j, steps in followers[i]:
            base[j] = max(base[j], base[i] + steps)
            missing[j] -= 1
            if missing[j] == 0:
                ready.append(j)
    at = pa.array(ready, pa.int64())
    return pa.table({"conv_id": got["conv_id"].take(at), "end": got["node"].take(at),
                     "base": pa.array([base[i] for i in ready], pa.int64())})


def _settled(waiting: DataFrame, settled: DataFrame, ranked: DataFrame, block: int) -> DataFrame:
    """``conv_id``, ``end``, ``base`` of ``settled`` and of all nodes that follow from it.

    Nodes are dealt into blocks of ``block`` neighbours in their order. A round settles all that can be
    settled inside a block at once, and only what crosses blocks waits for the next round.
    """
    blocks = written(ranked.select("conv_id", F.col("call_id").alias("node"), F.floor(F.col("rank") / block).alias("block")), "blocks")
    of_end = blocks.select("conv_id", F.col("node").alias("end"), F.col("block").alias("end_block"))
    placed = written(waiting.join(blocks, ["conv_id", "node"]).join(of_end, ["conv_id", "end"], "left"), "waiting")
    here = F.col("block").eqNullSafe(F.col("end_block"))
    node = ["block", "conv_id", "node"]
    # a node has at most as many dependencies inside its block as the block has nodes
    nodes = written(placed.groupBy(*node, "k").agg(F.collect_list(F.when(here, F.struct("end", "steps"))).alias("inner")), "nodes")
    outer = written(placed.where(~here).select(*node, "end", "steps"), "outer")
    kinds = dict(blocks.dtypes)
    new, arrived = settled, None
    while True:
        came = (outer.join(new, ["conv_id", "end"])
                .select(*node, F.lit(1).cast("long").alias("n"), (F.col("base") + F.col("steps")).alias("value")))
        known = came if arrived is None else arrived.union(came.select(arrived.columns))
        touched = new.select("conv_id", "end").join(outer, ["conv_id", "end"]).select("block").distinct()
        arrived = written(known.groupBy(*node).agg(F.sum("n").alias("n"), F.max("value").alias("value")), "arrived")
        found = (nodes.join(touched, "block", "left_semi").join(arrived, node, "left")
                 .select(*node, "k", "inner", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("value", F.lit(0)).alias("value"))
                 .groupBy("block").applyInArrow(_settle_block, f"conv_id {kinds['conv_id']}, end {kinds['node']}, base long"))
        new = written(found.join(settled.select("conv_id", "end"), ["conv_id", "end"], "left_anti"), "settled")
        if not new.take(1):
            return settled
        settled = written(settled.unionByName(new), "settled")


def levels(calls: DataFrame, block: int = BLOCK_CALLS) -> DataFrame:
    """``conv_id``, ``call_id``, ``level`` (null on or behind a cycle) of unique calls with ``depends_on``.

    With a column ``turn`` blocks follow it; results do not depend on it, nor on ``block``.
    """
    edges = calls.select(*_AT, F.explode(F.array_distinct("depends_on")).alias("dep"))
    named = calls.select("conv_id", F.col("call_id").alias("dep"))
    edges = written(edges.join(named, ["conv_id", "dep"]), "call-edges")
    counts = edges.groupBy(*_AT).agg(F.count("*").alias("k"), F.min("dep").alias("dep"))
    nodes = calls.select(*_AT).join(counts, _AT, "left")
    # a chain node points to its only dependency; all other nodes are ends of chains
    chain = written(nodes.select(*_AT, F.when(F.col("k") == 1, F.col("dep")).alias("to"),
                                 F.when(F.col("k") == 1, 1).otherwise(0).cast("long").alias("steps")), "chains")
    total = chain.where("to IS NOT NULL").count()
    for _ in range(math.ceil(math.log2(total + 1)) + 1 if total else 0):
        ahead = chain.where("to IS NOT NULL").select(
            "conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        joined = chain.join(ahead, ["conv_id", "to"], "left")
        done = F.col("next").isNull()
        moved = joined.select(*_AT, F.when(done, F.col("to")).otherwise(F.col("next")).alias("to"),
                              (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), (~done).alias("moved"))
        chain = written(moved, "chains")
        moving = bool(chain.where("moved").take(1))
        chain = chain.drop("moved")
        if not moving:
            break
    ends = nodes.where("k IS NULL OR k > 1").select("conv_id", F.col("call_id").alias("end"), F.coalesce("k", F.lit(0)).alias("k"))
    # every node hangs on an end of a chain, or on a cycle
    hung = written(chain.select(*_AT, F.coalesce("to", "call_id").alias("end"), "steps").join(ends, ["conv_id", "end"]), "hung")
    settled = written(ends.where("k = 0").select("conv_id", "end", F.lit(0).cast("long").alias("base")), "settled")
    several = edges.join(ends.where("k > 1").select("conv_id", F.col("end").alias("call_id"), "k"), _AT)
    waiting = written(several.select("conv_id", F.col("call_id").alias("node"), "k", F.col("dep").alias("call_id"))
                      .join(hung.select(*_AT, "end", "steps"), _AT)
                      .select("conv_id", "node", "k", "end", (F.col("steps") + 1).alias("steps")), "waiting")
    order = ["conv_id", *(["turn"] if "turn" in calls.columns else []), "call_id"]
    several = calls.select(*order).join(ends.where("k > 1").select("conv_id", F.col("end").alias("call_id")), _AT)
    if waiting.take(1):
        settled = _settled(waiting, settled, _ranked(several, order), block)
    found = hung.join(settled, ["conv_id", "end"]).select(*_AT, (F.col("base") + F.col("steps")).alias("level"))
    return calls.select(*_AT).join(found, _AT, "left")


def positions(calls: DataFrame) -> DataFrame:
    """``conv_id``, ``call_id``, ``position`` from 0 in the order of level, turn and identifier."""
    ranked = _ranked(calls.select(*_AT, "level", "turn"), ["conv_id", F.col("level").asc_nulls_last(), "turn", "call_id"])
    begin = ranked.groupBy("conv_id").agg(F.min("rank").alias("first"))
    return ranked.join(begin, "conv_id").select(*_AT, (F.col("rank") - F.col("first")).alias("position"))


_TYPES = {"string": lambda v: isinstance(v, str), "integer": lambda v: isinstance(v, int) and not isinstance(v, bool),
          "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "boolean": lambda v: isinstance(v, bool),
          "array": lambda v: isinstance(v, list), "object": lambda v: isinstance(v, dict)}


class TooLarge(ValueError):
    """A number that no double holds."""


def _number(text: str) -> float | int:
    value = float(text)
    if math.isinf(value):
        raise TooLarge(text)
    return int(value) if value.is_integer() and abs(value) < 2 ** 53 else value


def _constant(text: str):
    raise ValueError(text)


def check_arguments(text: str | None, schema: list[dict] | None) -> tuple[object, list[str]]:
    """Parsed arguments and what is wrong with them, in order of the parameter names."""
    try:
        value = json.loads(text or "", parse_float=_number, parse_constant=_constant)
    except TooLarge:
        return None, ["number too large"]
    except (ValueError, RecursionError):
        return None, ["not json"]
    if schema is None:
        return value, ["unknown tool"]
    if not isinstance(value, dict):
        return value, ["not an object"]
    known = {p["param"]: p for p in schema}
    wrong = [(n, "missing") for n, p in known.items() if p["required"] and n not in value]
    wrong += [(n, "unknown") for n in value if n not in known]
    wrong += [(n, "type") for n, v in value.items() if n in known and not _TYPES.get(known[n]["type"], lambda v: True)(v)]
    return value, [_escaped(f"{what} {name}") for name, what in sorted(wrong)]


def _escaped(text: str) -> str:
    """Halves of surrogate pairs, which no text in UTF-8 holds, as their JSON escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    return _escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


_UNREAD = (["not json"], ["number too large"])


def _result_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("call_id").to_pylist(), batch.column("content").to_pylist())
        records = pa.array([canonical({"id": i, "result": c}) for i, c in rows], pa.string())
        keep = [n for n in batch.schema.names if n != "content"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), records], names=[*keep, "record"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        errors, records = [], []
        for r in batch.to_pylist():
            value, wrong = check_arguments(r["arguments"], r["schema"])
            errors.append(wrong)
            records.append(canonical({
                "arguments": r["arguments"] if wrong[:1] in _UNREAD else value, "id": r["call_id"], "name": r["tool"],
                "result": r["content"]}))
        keep = [n for n in batch.schema.names if n not in ("arguments", "schema", "content")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in keep), pa.array(errors, pa.list_(pa.string())), pa.array(records, pa.string())],
            names=[*keep, "errors", "record"])


def _schema(rows: DataFrame, without: tuple[str, ...], more: str) -> str:
    return ", ".join(f"{n} {t}" for n, t in rows.dtypes if n not in without) + ", " + more


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and per result that goes with none: identifiers, tool, status, errors, level, position and record."""
    kept, lost = first_of_each(calls.select(*_AT, "turn", "tool", "arguments", "depends_on"), ["turn", "tool", "arguments", "depends_on"])
    kept = written(kept, "calls")
    answers, more = first_of_each(results.select(*_AT, F.col("turn").alias("result_turn"), "content"), ["result_turn", "content"])
    answers = written(answers, "results")
    ordered = written(levels(kept.select(*_AT, "turn", "depends_on")).join(kept.select(*_AT, "turn"), _AT), "levels")
    places = ordered.drop("turn").join(positions(ordered), _AT)
    by_tool = schemas.groupBy("tool").agg(F.collect_list(F.struct("param", "type", "required")).alias("schema"))

    def recorded(rows: DataFrame) -> DataFrame:
        full = rows.join(by_tool, "tool", "left")
        return full.mapInArrow(_records, _schema(full, ("arguments", "content", "schema"), "errors array<string>, record string"))

    linked = recorded(kept.drop("depends_on").join(answers, _AT, "left").join(places, _AT))
    status = (F.when(F.col("level").isNull(), "cyclic").when(F.size("errors") > 0, "invalid")
              .when(F.col("result_turn").isNull(), "unanswered").otherwise("ok"))
    columns = [*_AT, "turn", "tool", "status", F.array_join("errors", ";").alias("errors")]
    linked = linked.withColumn("status", status).select(*columns, "level", "position", "result_turn", "record")
    nameless = F.col("conv_id").isNull() | F.col("call_id").isNull()
    others = recorded(lost.drop("depends_on").withColumns({
        "content": F.lit(None).cast("string"), "status": F.when(nameless, "no_id").otherwise("duplicate")}))
    orphans = answers.join(kept.select(*_AT), _AT, "left_anti").withColumn("status", F.lit("orphan"))
    repeated = more.withColumn("status", F.when(nameless, "orphan").otherwise("repeated")).select(*orphans.columns)
    unmatched = orphans.unionByName(repeated)
    unmatched = unmatched.mapInArrow(_result_records, _schema(unmatched, ("content",), "record string"))
    return (linked.unionByName(others.select(*columns, "record"), allowMissingColumns=True)
            .unionByName(unmatched, allowMissingColumns=True))


def calls_of_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stand-in calls and results: the given conversations hold none, so turns stand for them.

    A user turn calls a tool that its number names, with its text and the number of characters as
    arguments; every third call lacks its parameter ``lang``. It depends on the user turn before it
    and, if its number divides by eight, also on the one four turns earlier. An assistant turn is the
    result of the call of the turn before it.
    """
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    turn = F.col("turn")
    tool = F.element_at(F.array(*[F.lit(t) for t in ("search", "summarise", "translate")]), (F.pmod(turn, F.lit(3)) + 1).cast("int"))
    body = F.coalesce(F.col("text"), F.lit(""))
    lang = F.when(F.pmod(F.length(body) + turn, F.lit(3)) != 0, F.lit("en"))
    arguments = F.to_json(F.struct(body.alias("query"), F.length(body).alias("limit"), lang.alias("lang")))
    depends = F.array_compact(F.array(F.when(turn >= 2, name(turn - 2)),
                                      F.when((turn >= 4) & (F.pmod(turn, F.lit(8)) == 0), name(turn - 4))))
    calls = conversations.where("role = 'user'").select("conv_id", name(turn).alias("call_id"), "turn", tool.alias("tool"),
                                                        arguments.alias("arguments"), depends.alias("depends_on"))
    results = conversations.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), "turn",
                                                               F.col("text").alias("content"))
    return calls, results


#: Parameters of the stand-in tools.
STANDIN_SCHEMAS = [("search", "query", "string", True), ("search", "limit", "integer", True), ("search", "lang", "string", False),
                   ("summarise", "query", "string", True), ("summarise", "limit", "integer", False),
                   ("translate", "query", "string", True), ("translate", "limit", "integer", True),
                   ("translate", "lang", "string", True)]


def standin_schemas(spark) -> DataFrame:
    return spark.createDataFrame(STANDIN_SCHEMAS, "tool string, param string, type string, required boolean")
