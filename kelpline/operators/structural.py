"""Deeply nested records to related flat tables (problem 1).

Structural-variant tables.  A bottom-up *tree automaton* assigns a state to each
node of a record, elements of lists included, from the symbol of the node (absent, null,
text, number, boolean, array, object) and the states of its children.  The state of a node
picks the typed subtype table its content goes to; every subtype table keeps the keys common to all
of them (record key, place of the parent, parent shape), so rows can be joined back.

Everything is JVM-side: the record is parsed once into a VARIANT, states are CASE
expressions over it, and ``routed_variants`` gives all subtype tables in one scan, a tagged
union of them; each table is a part of it.  Symbols are told by typed probes that look at one
level only, and the probes' results are what the rows are made of.
The sole shuffle is the choice of the last readable delivery of each record; Spark
limits it to one row per key and partition before the exchange, so a hot key is cheap.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kelpline.functions.frames import pick

LIST = "array<variant>"


def as_list(v: Column) -> Column:
    return F.try_variant_get(v, "$", LIST)


def as_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def as_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def symbol(v: Column, array: Column | None = None, obj: Column | None = None) -> Column:
    """The ranked symbol of a node, the automaton's input alphabet.

    *array* and *obj* are probes for these kinds where they are at hand, null if the node is none.
    Only a scalar is asked for its schema, since for a list or an object that walks all below it."""
    scalar = F.coalesce(F.element_at(F.create_map(*map(F.lit, SCALARS)), F.schema_of_variant(v)), F.lit("number"))
    return (
        F.when(v.isNull(), "absent")
        .when(F.is_variant_null(v), "null")
        .when((as_list(v) if array is None else array).isNotNull(), "array")
        .when((as_object(v) if obj is None else obj).isNotNull(), "object")
        .otherwise(scalar)
    )


def text_symbol(json: Column) -> Column:
    """The symbol of a JSON text, known to be valid, by its first character."""
    first = F.substring(F.ltrim(json, F.lit(" \t\r\n")), 1, 1)
    return F.when(json.isNull(), "absent").otherwise(
        F.coalesce(F.element_at(F.create_map(*map(F.lit, FIRST)), first), F.lit("number"))
    )


#: Spark's type text of a scalar VARIANT -> symbol; all others are numbers.
SCALARS = ("STRING", "text", "BOOLEAN", "boolean")
#: First character of a JSON text -> symbol.
FIRST = ("{", "object", "[", "array", '"', "text", "t", "boolean", "f", "boolean", "n", "null")


@dataclass(frozen=True)
class Transition:
    """``symbol(child states) -> state``; *children* names the states demanded of children."""

    symbol: str
    state: str
    children: dict[str, tuple[str, ...]] = field(default_factory=dict)


class TreeAutomaton:
    """Transitions per kind of node, compiled to CASE expressions bottom-up.

    A node no transition accepts gets the state ``other``: it is kept in the
    supertype table and has no subtype rows.
    """

    def __init__(self, transitions: dict[str, Sequence[Transition]]):
        self.transitions = transitions

    def state(self, kind: str, sym: Column, children: dict[str, Column] | None = None) -> Column:
        children = children or {}
        case = F.when(F.lit(False), F.lit("other"))
        for t in self.transitions[kind]:
            test = sym == t.symbol
            for child, states in t.children.items():
                test = test & children[child].isin(*states)
            case = case.when(test, F.lit(t.state))
        return case.otherwise(F.lit("other"))


#: Shapes of inventory reports, leaves first.
INVENTORY = TreeAutomaton(
    {
        "file_digests": [
            Transition("absent", "none"),
            Transition("null", "none"),
            Transition("object", "path_map"),
            Transition("array", "path_list"),
        ],
        "limitations": [
            Transition("absent", "none"),
            Transition("null", "none"),
            Transition("text", "single_text"),
            Transition("object", "single_code"),
            Transition("array", "code_list"),
        ],
        # Elements of lists; the child of an object is its path or code.
        "file_item": [Transition("object", "entry", {"path": ("text", "number", "boolean")})],
        "limit_item": [
            Transition("text", "text"),
            Transition("object", "coded", {"code": ("text", "number", "boolean")}),
        ],
        "plugin": [
            Transition(
                "object",
                "complete",
                {
                    "file_digests": ("path_map", "path_list"),
                    "limitations": ("single_text", "single_code", "code_list"),
                },
            ),
            Transition("object", "files_only", {"file_digests": ("path_map", "path_list")}),
            Transition(
                "object", "limits_only", {"limitations": ("single_text", "single_code", "code_list")}
            ),
            Transition("object", "bare"),
            Transition("null", "hole"),
        ],
        "plugins": [
            Transition("array", "many"),
            Transition("object", "single"),
            Transition("absent", "none"),
            Transition("null", "none"),
        ],
        "result": [
            Transition("absent", "unwrapped"),
            Transition("object", "wrapped"),
            Transition("text", "wrapped_text"),
        ],
    }
)


def last_readable(df: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """(key, record VARIANT) of the last row, by *order*, whose payload is readable.

    Rows with a null or broken payload never count.  Rows with a null key stand
    for one record.  A null *order* is the earliest; among ties the greatest hash
    of the payload text counts, so the choice does not depend on the plan.

    Unreadable rows sort last instead of being filtered first: a filter on the
    parsed record would be pushed below the parse and parse each payload again.
    """
    parsed = df.select(
        key,
        order,
        F.xxhash64(payload).alias("tie"),
        text_symbol(F.col(payload)).alias("root_sym"),
        F.try_parse_json(F.col(payload)).alias("root"),
    )
    result = parsed.select("*", F.try_variant_get("root", "$.result", "variant").alias("result"))
    states = result.select("*", INVENTORY.state("result", symbol(F.col("result"))).alias("shape"))
    wrapped = states.select("*", F.when(F.col("shape") == "wrapped_text", as_text(F.col("result"))).alias("inner"))
    inner = wrapped.select(
        key,
        order,
        "tie",
        F.when(F.col("shape") == "unwrapped", F.col("root_sym"))
        .when(F.col("shape") == "wrapped", "object")
        .when(F.col("shape") == "wrapped_text", text_symbol(F.col("inner")))
        .alias("record_sym"),
        F.when(F.col("shape") == "unwrapped", F.col("root"))
        .when(F.col("shape") == "wrapped", F.col("result"))
        .when(F.col("shape") == "wrapped_text", F.try_parse_json("inner"))
        .alias("record"),
    )
    readable = inner.select("*", (F.col("record").isNotNull() & F.col("record_sym").eqNullSafe("object")).alias("readable"))
    newest = Window.partitionBy(key).orderBy(
        F.col("readable").desc(), F.col(order).desc_nulls_last(), F.col("tie").desc()
    )
    ranked = readable.withColumn("nth", F.row_number().over(newest))
    return ranked.where("nth = 1 AND readable").select(key, "record")


KEYS = ["report_id", "plugin_pos", "plugin_id"]


def plugin_supertype(reports: DataFrame) -> DataFrame:
    """One row per plugin record: KEYS, the three shape states, and the contents of the children by
    probe: files_map, files_list, limits_list and limits.  The supertype of all subtype tables."""
    df = pick(reports, "report_id", "received_at", "payload")
    last = last_readable(df, "report_id", "received_at", "payload")
    nodes = last.select("report_id", F.try_variant_get("record", "$.plugins", "variant").alias("node"))
    probed = nodes.select("report_id", "node", as_list(F.col("node")).alias("list"))
    shaped = probed.select("report_id", "node", "list", INVENTORY.state("plugins", symbol(F.col("node"), F.col("list"))).alias("plugins_shape"))
    listed = shaped.select(
        "report_id",
        F.posexplode(
            F.when(F.col("plugins_shape") == "many", F.col("list")).when(F.col("plugins_shape") == "single", F.array("node"))
        ).alias("plugin_pos", "plugin"),
    )
    child = listed.select(
        "report_id",
        F.col("plugin_pos").cast("long").alias("plugin_pos"),
        "plugin",
        F.try_variant_get("plugin", "$.id", "string").alias("id"),
        F.try_variant_get("plugin", "$.file_digests", "variant").alias("files"),
        F.try_variant_get("plugin", "$.file_digests", "map<string,string>").alias("files_map"),
        F.try_variant_get("plugin", "$.file_digests", LIST).alias("files_list"),
        F.try_variant_get("plugin", "$.limitations", "variant").alias("limits"),
        F.try_variant_get("plugin", "$.limitations", LIST).alias("limits_list"),
    )
    # A record with any child found is an object; only the others are probed whole.
    found = F.coalesce("id", F.when(F.col("files").isNotNull() | F.col("limits").isNotNull(), "")).isNotNull()
    leaves = child.select(
        "*",
        F.when(found, "object").otherwise(symbol(F.col("plugin"))).alias("plugin_sym"),
        INVENTORY.state("file_digests", symbol(F.col("files"), F.col("files_list"), F.col("files_map"))).alias("files_shape"),
        INVENTORY.state("limitations", symbol(F.col("limits"), F.col("limits_list"))).alias("limits_shape"),
    )
    shapes = {"file_digests": F.col("files_shape"), "limitations": F.col("limits_shape")}
    parents = leaves.select(
        "report_id",
        "plugin_pos",
        F.coalesce("id", F.lit("")).alias("plugin_id"),
        INVENTORY.state("plugin", F.col("plugin_sym"), shapes).alias("plugin_shape"),
        *["files_shape", "limits_shape", "files_map", "files_list", "limits_list", "limits"],
    )
    return parents.where(~F.col("plugin_shape").isin("hole", "other"))


def _named(v: Column, name: str) -> tuple[Column, Column]:
    """(state of the child *name* of an object, its text): a list or an object has no text here."""
    child = F.try_variant_get(v, f"$.{name}", "variant")
    return symbol(child), as_text(child)


def _file_items(items: Column) -> Column:
    """(key, digest) of the elements of a list of files whose state is 'entry', in order."""

    def row(v: Column) -> Column:
        state, path = _named(v, "path")
        sym = F.when(path.isNotNull(), "object").otherwise("absent")
        entry = INVENTORY.state("file_item", sym, {"path": state}) == "entry"
        return F.when(entry, F.struct(path.alias("key"), F.try_variant_get(v, "$.digest", "string").alias("digest")))

    return F.filter(F.transform(items, row), lambda r: r.isNotNull())


def _limit_items(items: Column) -> Column:
    """(key, null) of the elements of a list of limitations: texts, and objects by their code."""

    def row(v: Column) -> Column:
        state, code = _named(v, "code")
        shape = INVENTORY.state("limit_item", F.when(code.isNotNull(), "object").otherwise(symbol(v)), {"code": state})
        key = F.when(shape == "text", as_text(v)).when(shape == "coded", code)
        return F.when(key.isNotNull(), F.struct(key.alias("key"), F.lit(None).cast("string").alias("digest")))

    return F.filter(F.transform(items, row), lambda r: r.isNotNull())


#: Subtype table -> kind of its rows.
SUBTYPES = {
    "plugins": "plugin",
    "files_path_map": "file_digest",
    "files_path_list": "file_digest",
    "limits_single": "limitation",
    "limits_list": "limitation",
}


def routed_variants(reports: DataFrame) -> DataFrame:
    """The tagged union of all subtype tables, in one scan: KEYS, plugin_shape, subtype and rows, an array of
    (key, digest), one row per plugin and subtype that the states of its nodes pick."""
    p = plugin_supertype(reports)
    row = "array<struct<key:string,digest:string>>"
    own = F.array(F.struct(F.col("plugin_id").alias("key"), F.lit(None).cast("string").alias("digest"))).cast(row)
    of_map = F.transform(F.map_entries("files_map"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("digest")))
    route = lambda name, rows: F.struct(name.alias("subtype"), rows.cast(row).alias("rows"))
    files, limits = F.col("files_shape"), F.col("limits_shape")
    items = F.when(files == "path_map", of_map).otherwise(_file_items(F.col("files_list")))
    single = limits.isin("single_text", "single_code")
    codes = _limit_items(F.when(single, F.array("limits")).otherwise(F.col("limits_list")))
    routes = F.array(
        route(F.lit("plugins"), own),
        F.when(files.isin("path_map", "path_list"), route(F.concat(F.lit("files_"), files), items)),
        F.when(single | (limits == "code_list"), route(F.when(single, "limits_single").otherwise("limits_list"), codes)),
    )
    return p.select(*KEYS, "plugin_shape", F.inline(F.filter(routes, lambda r: r.isNotNull())))


def subtype_tables(reports: DataFrame) -> dict[str, DataFrame]:
    """The typed tables: ``plugins`` (supertype), ``files_path_map``, ``files_path_list`` (path, digest),
    ``limits_single`` and ``limits_list`` (limitation); all share KEYS and plugin_shape.  A path or
    limitation listed twice has a row each time."""
    routed = routed_variants(reports)
    out = {}
    for name, kind in SUBTYPES.items():
        rows = routed.where(F.col("subtype") == name).select(*KEYS, "plugin_shape", F.inline("rows"))
        columns = {"plugin": [], "file_digest": [F.col("key").alias("path"), F.col("digest")], "limitation": [F.col("key").alias("limitation")]}
        out[name] = rows.select(*KEYS, "plugin_shape", *columns[kind])
    return out


def flatten_reports(reports: DataFrame) -> DataFrame:
    """The union of all subtype tables: report_id, plugin_pos, child_kind, child_key.

    One row per plugin ('plugin', id or ''), per distinct path ('file_digest') and
    per distinct limitation ('limitation').  Missing, null or empty lists give none;
    list elements that are null or lack a path or code, or have a list or object there, give none; duplicates within
    a plugin are removed inside its row, without a shuffle.  An empty table gives an
    empty result.
    """
    kinds = F.create_map(*[F.lit(x) for pair in SUBTYPES.items() for x in pair])
    keys = F.array_distinct(F.transform("rows", lambda r: r["key"]))
    return routed_variants(reports).select(
        "report_id", "plugin_pos", F.element_at(kinds, F.col("subtype")).alias("child_kind"), F.explode(keys).alias("child_key")
    )
