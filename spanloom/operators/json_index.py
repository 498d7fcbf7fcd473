"""Strict JSON with offsets, read by a structural index: tokens, depths, partners, containers, all as running sums over many texts.

A text's bytes are told apart by a table; behind an odd number of quotes lies a string, so brackets in quotes are no brackets. The
depth of a token is a running sum of brackets; sorted by depth, an opening bracket and its partner stand side by side, and each
token with the one before it says whether it may stand there. So nesting costs nothing but the pointers, which are as long as the
nesting is deep. Texts are dealt by source, once; some SLICE bytes of them are read at a time where they lie, and nothing is sorted
but the brackets, keys and depths of such a slice.

`texts` is (source_id, text), one row a source. A text fails as a whole: by other signs between tokens, a wrong order, an open
or superfluous bracket, a literal that is none, a lone surrogate, a key twice in an object, or nothing in it. A byte order mark at
its beginning is skipped but counts as one character. Null is no JSON. Empty tables have no nodes and no failures.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import ORDER_ITEMS_SQL, order_json

# What JSON allows, and keys and words that tell what a value is.
STRING = r'\A"(?:[^"\\]|\\["\\/bfnrt]|\\u(?:[0-9abcefABCEF][0-9a-fA-F]{3}|[dD][0-7][0-9a-fA-F]{2})|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2})*"\z'
LITERAL = r"\A(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)\z"
PERCENTAGE = r"(?U)\s*[+-]?\d+(?:\.\d+)?\s*%\s*"
VALUE_KEYS, UNIT_KEYS, OWNER_KEYS = ("value", "amount", "limit"), ("unit", "units"), ("owner", "service", "name", "entity")
TIME_KEYS, TRACE_KEYS = ("timestamp", "time", "date", "created_at"), ("trace_id", "request_id", "span_id", "correlation_id")
LEAVES = {
    "numeric.unit": ("unit", "units", "duration_unit"),
    "identifier.generic": ("owner", "service", "name", "entity", "account"),
    "temporal.timestamp": ("timestamp", "time", "date", "created_at", "updated_at"),
    "identifier.trace_request": ("trace_id", "request_id", "span_id", "correlation_id"),
    "identifier.error_code": ("error_code", "status_code", "code"),
}
SLICE = 1 << 22
FAILURE = r"(?Ui)\b(?:error|failed|failure|critical)\b"


# What a byte is: a quote, a bracket, a colon or comma, a blank, a control character, or nothing special; and the end of a text.
QUOTE, OBJECT, ARRAY, END_OBJECT, END_ARRAY, COLON, COMMA, BLANK, LINE, CONTROL, EDGE, WORD = range(1, 13)
BYTES = np.zeros(256, np.uint8)
BYTES[:32] = CONTROL
for _signs, _class in (('"', QUOTE), ("{", OBJECT), ("[", ARRAY), ("}", END_OBJECT), ("]", END_ARRAY), (":", COLON), (",", COMMA), (" ", BLANK), ("\t\r\n", LINE)):
    BYTES[[ord(c) for c in _signs]] = _class
# Roles of tokens beside their classes, and which may follow which.
KEY, ITEM_COMMA, STRAY = 13, 14, 15
FOLLOWS = np.zeros((16, 16), bool)
for _before, _after in (
    (EDGE, (OBJECT, ARRAY, WORD)), (OBJECT, (KEY, END_OBJECT)), (ARRAY, (OBJECT, ARRAY, WORD, END_ARRAY)), (KEY, (COLON,)), (COLON, (OBJECT, ARRAY, WORD)), (COMMA, (KEY,)), (ITEM_COMMA, (OBJECT, ARRAY, WORD)),
    *((v, (COMMA, ITEM_COMMA, END_OBJECT, END_ARRAY, EDGE)) for v in (WORD, END_OBJECT, END_ARRAY)),
):
    FOLLOWS[_before, list(_after)] = True
NODE = "node bigint, parent bigint, pointer string, key string, place bigint, kind string, start bigint, end bigint, key_start bigint, key_end bigint, value string, first boolean, size bigint, objects bigint, peers bigint, holder bigint, nth bigint, raw string"


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings of these stretches of bytes."""
    ends = np.cumsum(end - start)
    at = np.arange(ends[-1] if ends.size else 0) + np.repeat(start - ends + (end - start), end - start)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(data[at]))


def _tokens(texts: pa.Array) -> SimpleNamespace:
    """The tokens of all texts in order, each text between two edges: kind, start and end in bytes, text (of), number in it (i),
    whether it is a string with escapes; what is known to be no JSON is marked in bad."""
    held = pc.binary_join_element_wise(pc.fill_null(texts, "").cast(pa.string()), "", "\n")
    bounds = np.frombuffer(held.buffers()[1], np.int32, len(held) + 1).astype(np.int64)
    data = np.frombuffer(held.buffers()[2], np.uint8)[: bounds[-1]].copy()
    # Bytes that continue a character, counted: places in bytes less these are places in characters.
    more = np.concatenate([[0], np.cumsum((data & 0xC0) == 0x80)])
    marked = bounds[:-1][np.diff(bounds) > 3]
    marked = marked[(data[marked] == 0xEF) & (data[marked + 1] == 0xBB) & (data[marked + 2] == 0xBF)]
    for k in range(3):
        data[marked + k] = 32
    kinds = BYTES[data]
    # A sign behind an odd number of backslashes in a row is escaped.
    slashes = np.flatnonzero(data == 92)
    new = np.diff(slashes, prepend=-2) != 1
    nth = np.arange(slashes.size) - np.maximum.accumulate(np.where(new, np.arange(slashes.size), 0))
    escaped = slashes[nth % 2 == 0] + 1
    kinds[escaped[kinds[escaped] == QUOTE]] = 0
    kinds[bounds[1:] - 1] = EDGE

    at = np.concatenate([[-1], np.flatnonzero(kinds)])
    kind = np.concatenate([[EDGE], kinds[at[1:]]]).astype(np.uint8)
    of = np.concatenate([[0], np.cumsum(kind == EDGE)[:-1] - 1])
    quotes = np.cumsum(kind == QUOTE)
    inside = ((quotes - (kind == QUOTE) - quotes[np.flatnonzero(kind == EDGE)][of]) % 2).astype(bool)
    inside[0] = False
    bad = np.zeros(len(texts), bool)
    bad[of[inside & ((kind == LINE) | (kind == EDGE)) | (kind == CONTROL)]] = True
    stays = ~inside | (kind == QUOTE) | (kind == EDGE)
    at, kind, of, inside = at[stays], kind[stays], of[stays], inside[stays]
    # Behind each sign may stand a word, up to the next one; a string reaches to its second quote.
    opens = (kind == QUOTE) & ~inside
    following = np.concatenate([at[1:], at[-1:] + 1])
    pair = lambda a, b: np.stack([a, b], 1).ravel()
    is_one = pair((kind >= OBJECT) & (kind <= COMMA) | opens | (kind == EDGE), ~opens & (following > at + 1))
    pick = np.flatnonzero(is_one)
    t = SimpleNamespace(data=data, more=more, bounds=bounds, bad=bad)
    t.kind, t.of = pair(kind, np.full(kind.size, WORD, np.uint8))[pick], pair(of, np.concatenate([of[1:], of[-1:]]))[pick]
    t.start, t.end = pair(at, at + 1)[pick], pair(np.where(opens, following + 1, at + 1), following)[pick]
    t.edges = np.flatnonzero(t.kind == EDGE)
    t.i = np.arange(t.kind.size) - t.edges[t.of] - 1
    t.string = t.kind == QUOTE
    t.kind[t.string] = WORD
    own = np.searchsorted(t.start[t.string], slashes, "right") - 1
    t.escaped = np.zeros(t.kind.size, bool)
    t.escaped[np.flatnonzero(t.string)[own[slashes < np.append(t.end[t.string], -1)[own]]]] = True
    return t


def _boxes(t: SimpleNamespace) -> None:
    """Adds to tokens their depth, for an opening bracket its partner, and the bracket that opens what a token stands in (-1: none)."""
    move = np.isin(t.kind, (OBJECT, ARRAY)).astype(np.int64) - np.isin(t.kind, (END_OBJECT, END_ARRAY))
    open_now = np.cumsum(move)
    depth = open_now - open_now[t.edges[t.of]]
    t.bad[t.of[depth < 0]] = True
    t.bad[np.diff(open_now[t.edges]) != 0] = True
    t.level = depth - (move > 0)
    brackets = np.flatnonzero((move != 0) & ~t.bad[t.of])
    row = t.of[brackets] * (t.level[brackets].max(initial=0) + 1) + t.level[brackets]
    order = np.argsort(row, kind="stable")
    opens, closes, row = brackets[order[::2]], brackets[order[1::2]], row[order[::2]]
    t.mate = np.full(t.kind.size, -1)
    t.mate[opens], t.mate[closes] = closes, opens
    t.bad[t.of[opens[t.kind[closes] != t.kind[opens] + 2]]] = True
    # Around an opening bracket stands the last one before it that is a level higher.
    nested = t.level[opens] > 0
    outer = np.full(t.kind.size, -1)
    outer[opens[nested]] = opens[np.searchsorted(row * t.kind.size + opens, (row[nested] - 1) * t.kind.size + opens[nested]) - 1]
    behind = np.where(move[brackets] > 0, brackets, outer[t.mate[brackets]])
    count = np.zeros(t.kind.size, np.int64)
    count[brackets] = 1
    t.box = np.concatenate([[-1], behind])[np.cumsum(count) - count]
    t.box[t.bad[t.of]] = -1
    t.shape = np.where(t.box < 0, EDGE, t.kind[t.box])


def _strings(t: SimpleNamespace, which: np.ndarray) -> pa.Array:
    """What these string tokens say."""
    said = _cut(t.data, t.start[which] + 1, t.end[which] - 1)
    escaped = t.escaped[which]
    if not escaped.any():
        return said
    lexemes = _cut(t.data, t.start[which[escaped]], t.end[which[escaped]])
    return pc.replace_with_mask(said, pa.array(escaped), pa.array(json.loads(f"[{','.join(lexemes.to_pylist())}]"), pa.string()))


def _read(texts: pa.Array) -> SimpleNamespace:
    """The tokens with what they stand in and their role; keys, words and what is no JSON (bad)."""
    t = _tokens(texts)
    _boxes(t)
    role = t.kind.copy()
    role[t.kind == COMMA] = np.where(t.shape == OBJECT, COMMA, np.where(t.shape == ARRAY, ITEM_COMMA, STRAY))[t.kind == COMMA]
    role[1:][t.string[1:] & np.isin(role[:-1], (OBJECT, COMMA))] = KEY
    t.bad[t.of[1:][~FOLLOWS[role[:-1], role[1:]]]] = True
    t.words = np.flatnonzero((t.kind == WORD) & ~t.string & ~t.bad[t.of])
    t.lexemes = _cut(t.data, t.start[t.words], t.end[t.words]).dictionary_encode()
    sound = pc.match_substring_regex(t.lexemes.dictionary, LITERAL).to_numpy(zero_copy_only=False)
    t.bad[t.of[t.words[~sound[t.lexemes.indices.to_numpy()]]]] = True
    odd = np.flatnonzero(t.escaped & ~t.bad[t.of])
    t.bad[t.of[odd[~pc.match_substring_regex(_cut(t.data, t.start[odd], t.end[odd]), STRING).to_numpy(zero_copy_only=False)]]] = True
    t.keys = np.flatnonzero((role == KEY) & ~t.bad[t.of])
    t.names = _strings(t, t.keys).dictionary_encode()
    pairs = np.sort(t.box[t.keys] * max(1, len(t.names.dictionary)) + t.names.indices.to_numpy())
    again = pairs[1:][pairs[1:] == pairs[:-1]] // max(1, len(t.names.dictionary))
    t.bad[t.of[again]] = True
    t.role = role
    return t


def _pointers(level: np.ndarray, up: np.ndarray, steps: pa.Array) -> pa.Array:
    """Pointers of nodes: level by level the pointer of the node above (up) and the step."""
    order = np.argsort(level, kind="stable")
    place = np.empty(order.size, np.int64)
    place[order] = np.arange(order.size)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(level))])
    made = [pa.array([""] * int(cuts[1]) if level.size else [], pa.string())]
    for before, a, b in zip(cuts, cuts[1:], cuts[2:], strict=False):
        own = order[a:b]
        made.append(pc.binary_join_element_wise(made[-1].take(pa.array(place[up[own]] - before)), steps.take(pa.array(own)), "/"))
    return pa.concat_arrays(made).take(pa.array(place))


def _nodes(texts: pa.Array) -> pa.Array:
    """Per text the list of its nodes, in order; empty for what is no JSON."""
    t = _read(texts)
    at = np.flatnonzero(np.isin(t.role, (OBJECT, ARRAY, WORD)) & ~t.bad[t.of])
    n, role, box, shape = at.size, t.role[at], t.box[at], t.shape[at]
    number = np.full(t.kind.size + 1, -1)
    number[at] = np.arange(n)
    up = np.where(box < 0, -1, number[box])
    has, keyed, listed = up >= 0, shape == OBJECT, shape == ARRAY
    some = lambda values, where: pa.array(values, mask=~where)
    # Members of a container in order: how many, how many objects, and the place of each.
    size, objects = np.bincount(up[has], minlength=n), np.bincount(up[has & (role == OBJECT)], minlength=n)
    inside = np.flatnonzero(listed)
    inside = inside[np.argsort(up[inside], kind="stable")]
    place = np.zeros(n, np.int64)
    place[inside] = np.arange(inside.size) - np.searchsorted(up[inside], up[inside])
    # Keys stand two tokens before their values.
    own = np.full(t.kind.size, -1)
    own[t.keys] = t.names.indices.to_numpy()
    name = np.where(keyed, own[at - 2], 0)
    key = t.names.dictionary.take(some(name, keyed))
    steps = pc.replace_substring(pc.replace_substring(t.names.dictionary, "~", "~0"), "/", "~1")
    most = int(place.max(initial=0)) + 1
    step = pa.concat_arrays([steps, pa.array(range(most)).cast(pa.string())]).take(pa.array(np.where(keyed, name, len(steps) + place)))
    # Kinds and values: of words by their lexemes, of strings what they say.
    signs = np.array(["array", "object", "string", "boolean", "null", "integer", "number"])
    lexemes = t.lexemes.dictionary.to_pylist()
    told = np.array([3 if x[0] in "tf" else 4 if x[0] == "n" else 6 if any(c in x for c in ".eE") else 5 for x in lexemes] or [0])
    word = np.full(t.kind.size, -1)
    word[t.words] = t.lexemes.indices.to_numpy()
    quoted, word = t.string[at], word[at]
    kind = np.where(quoted, 2, np.where(word >= 0, told[word], role == OBJECT))
    said = _strings(t, at[quoted])
    which = np.where(quoted, np.cumsum(quoted) - 1, len(said) + word)
    value = pa.concat_arrays([said, t.lexemes.dictionary]).take(some(which, quoted | (word >= 0)))
    first = t.bounds[t.of[at]]
    spot = lambda b: b - t.more[b] - first + t.more[first]
    end = np.where(role == WORD, t.end[at], t.end[t.mate[at]])
    before = np.where(keyed, at - 2, at)
    # Fields of a row, an object among two or more of an array: that array and the row's place; those that hold others with their text.
    row = (role == OBJECT) & listed
    peers = np.where(row, objects[up], 0)
    field = has & keyed & (peers[up] >= 2)
    nested = field & (role != WORD)
    raw = _cut(t.data, t.start[at[nested]], end[nested]).take(some(np.cumsum(nested) - 1, nested))
    i, boxed = t.i[at], role != WORD
    columns = [
        pa.array(i), some(i[up] if n else up, has), _pointers(t.level[at], up, step), key, some(place, listed), pa.array(signs[kind], pa.string()), pa.array(spot(t.start[at])), pa.array(spot(end)),
        some(spot(t.start[before]), keyed), some(spot(t.end[before]), keyed), value, pa.array(np.isin(t.role[before - 1], (OBJECT, ARRAY, EDGE))), some(size, boxed), some(objects, boxed), some(peers, row),
        some(i[up[up]] if n else up, field), some(place[up] if n else up, field), raw,
    ]
    ends = np.concatenate([[0], np.cumsum(np.bincount(t.of[at], minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, [f.split()[0] for f in NODE.split(", ")]))


def _sliced(made: Callable[[pa.Array], pa.Array], texts: pa.Array) -> pa.Array:
    """What is made of some SLICE bytes of texts at a time; a longer text is a slice of its own."""
    if not len(texts):
        return made(pa.array([""])).slice(0, 0)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return pa.concat_arrays([made(texts.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)])


def json_parsed(texts: DataFrame) -> DataFrame:
    """(source_id, text) dealt by source: what is read from a text stays there, so that nothing by source is shuffled again."""
    return texts.select("source_id", "text").repartition("source_id")


def json_failures(parsed: DataFrame) -> DataFrame:
    """(source_id, code): sources that aren't strict JSON."""
    bad = F.arrow_udf(lambda texts: _sliced(lambda some: pa.array(_read(some).bad), texts), "boolean")
    return parsed.filter(bad("text")).select("source_id", F.lit("INVALID_JSON").alias("code"))


def json_node_lists(parsed: DataFrame) -> DataFrame:
    """(source_id, n): the nodes of each text as one array, in order; empty for what is no JSON."""
    read = F.arrow_udf(lambda texts: _sliced(_nodes, texts), f"array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>")
    return parsed.select("source_id", read("text").alias("n"))


def json_nodes(parsed: DataFrame) -> DataFrame:
    """(source_id, node, parent, pointer, key, place, kind, start, end, key_start, key_end, value, ...): every node of the valid
    texts. `node` and `parent` number the tokens that begin them, `place` counts within an array; `value` is a string's text
    or the literal, and null for containers. Pointers escape ~ as ~0 and / as ~1; the root's is empty. `first` tells what begins
    its container; `size` and `objects` count a container's members and those that are objects; a row of an array has the number
    of these as `peers`. The fields of rows with peers have that array's number as `holder`, the row's place as `nth`, and the text
    of an object or array as `raw`.
    """
    return json_node_lists(parsed).select("source_id", F.explode("n").alias("n")).select("source_id", "n.*")


def escaped(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _obligations(node: Callable[[str], Column]) -> Column:
    """What a node and its key oblige to: an array of (what, start, end)."""
    kind = F.when(node("kind").isin("string", "integer", "number"), "value").otherwise(node("kind"))
    made = lambda what, start, end: F.struct(what.alias("what"), node(start).alias("start"), node(end).alias("end"))
    return F.array_compact(F.array(made(kind, "start", "end"), F.when(node("key").isNotNull(), made(F.lit("key"), "key_start", "key_end"))))


def path_obligations(nodes: DataFrame) -> DataFrame:
    """(source_id, class, pointer, what, start, end): one for every node and one for every key."""
    return nodes.select("source_id", F.lit("structured.json_schema_path").alias("class"), "pointer", F.explode(_obligations(F.col)).alias("o")).select("source_id", "class", "pointer", "o.*")


def path_sums(lists: DataFrame) -> DataFrame:
    """(path, what, n, sources, starts, ends): obligations by path with indices of arrays left out. A source's obligations are
    sorted where they lie, so that it counts where a path is new in it, and only sums are shuffled."""
    def listed(n: Column) -> Column:
        path = F.regexp_replace(n["pointer"], r"/\d+(?=/|$)", "/[]")
        return F.transform(_obligations(lambda c: n[c]), lambda o: F.struct(path.alias("path"), o["what"].alias("what"), o["start"].alias("start"), o["end"].alias("end")))

    rows = lists.select("source_id", F.sort_array(F.flatten(F.transform("n", listed))).alias("o"))
    same = lambda a, b: (a["path"] == b["path"]) & (a["what"] == b["what"])
    new = F.transform("o", lambda o, i: F.when(i > 0, (~same(o, F.get("o", i - 1))).cast("long")).otherwise(1))
    rows = rows.select(F.explode(F.arrays_zip("o", new.alias("new"))).alias("z"))
    return rows.groupBy("z.o.path", "z.o.what").agg(F.count("*").alias("n"), F.sum("z.new").alias("sources"), F.sum("z.o.start").alias("starts"), F.sum("z.o.end").alias("ends"))


def typed_leaves(nodes: DataFrame) -> DataFrame:
    """(source_id, class, pointer, kind, value, start, end): numbers, percentages in quotes, and nodes whose key names their meaning."""
    lower = F.lower("key")
    kinds = [F.when(F.col("kind").isin("integer", "number"), F.lit("numeric.number")), F.when((F.col("kind") == "string") & F.col("value").rlike(rf"\A{PERCENTAGE}\z"), F.lit("numeric.percentage"))]
    kinds += [F.when(lower.isin(*keys), F.lit(name)) for name, keys in LEAVES.items()]
    return nodes.select("source_id", F.explode(F.array_compact(F.array(*kinds))).alias("class"), "pointer", "kind", "value", "start", "end")


def comparable(cells: DataFrame) -> DataFrame:
    """cells with `same`, equal for equal values, whatever the order of keys and the blanks in them, and `even`, which takes
    numbers and booleans of one value for equal (1, 1.0 and true)."""
    quoted = F.when(F.col("kind") == "string", F.concat(F.lit('"'), "value")).otherwise(F.col("value"))
    every = cells.withColumn("same", F.when(F.col("kind").isin("object", "array"), F.to_json(F.try_parse_json("raw"))).otherwise(quoted))
    number = F.when(F.col("kind").isin("integer", "number"), F.col("value").cast("double")).when(F.col("kind") == "boolean", F.col("value").cast("boolean").cast("double"))
    return every.withColumn("even", F.coalesce(F.concat(F.lit("#"), number.cast("string")), "same"))


def anomalous_rows(nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(source_id, pointer, start, end, peer, status) of the objects of arrays with two objects or more that lack a key that another
    has, or hold the last value of a key whose values differ (peer), or whose status names a failure (status). Nodes hold what
    is compared, so the texts needn't be read again."""
    row, field = F.col("peers") >= 2, F.col("holder").isNotNull()
    told = F.when((F.lower("key") == "status") & field, F.col("node") * 2 + (~F.coalesce((F.col("kind") == "string") & F.col("value").rlike(FAILURE), F.lit(False))).cast("long"))
    own = lambda when, *c: F.when(when, F.struct(*c))
    # A row stands for itself among its fields, as one of its array (nth and holder are the fields' alone), so that nothing is joined.
    made = F.array_compact(F.array(
        own(row, F.col("parent").alias("array"), F.col("node").alias("row"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("bigint").alias("nth"), F.lit(None).cast("string").alias("same"), F.lit(None).cast("string").alias("even"), F.lit(None).cast("bigint").alias("told"), "pointer", "start", "end"),
        own(field, F.col("holder").alias("array"), F.col("parent").alias("row"), "key", "nth", "same", "even", told.alias("told"), F.lit(None).cast("string").alias("pointer"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end")),
    ))
    cells = comparable(nodes.filter(row | field)).select("source_id", F.explode(made).alias("c")).select("source_id", "c.*").repartition("source_id")
    per_key = Window.partitionBy("source_id", "array", "key")
    cells = cells.withColumn("last", F.max_by("even", "nth").over(per_key)).withColumn("new", F.col("nth") == F.max("nth").over(per_key)).withColumn("differ", F.min("same").over(per_key) != F.max("same").over(per_key))
    keyed = F.col("key").isNotNull()
    rows = cells.groupBy("source_id", "array", "row").agg(
        F.max("pointer").alias("pointer"), F.max("start").alias("start"), F.max("end").alias("end"), F.count("key").alias("keys"), F.max(keyed & F.col("differ") & (F.col("even") == F.col("last"))).alias("odd"),
        F.count(F.when(keyed & F.col("new"), 1)).alias("new"), F.min("told").alias("told"),
    )
    # Each key is new in one row only, that which has it last.
    rows = rows.withColumn("all_keys", F.sum("new").over(Window.partitionBy("source_id", "array")))
    peer = (F.col("keys") < F.col("all_keys")) | F.coalesce("odd", F.lit(False))
    rows = rows.select("source_id", "pointer", "start", "end", peer.alias("peer"), F.coalesce(F.col("told") % 2 == 0, F.lit(False)).alias("status"))
    return rows.filter("peer or status")


def object_relations(nodes: DataFrame) -> DataFrame:
    """(source_id, relation, pointer, ends): what the fields of an object have to do with each other, and with it; `ends` are
    the pointers of value, unit and owner, or of the object and its time or trace. Of several fitting keys the first of a list
    wins, of several fields of it the last. An object's pointer is that of any field without the last step."""
    names = {"value": VALUE_KEYS, "unit": UNIT_KEYS, "owner": OWNER_KEYS, "time": TIME_KEYS, "trace": TRACE_KEYS}
    fields = nodes.filter("key is not null").select("source_id", "parent", "node", F.lower("key").alias("key"), "pointer").filter(F.col("key").isin(*[k for keys in names.values() for k in keys]))
    best = lambda keys: F.min(F.when(F.col("key").isin(*keys), F.struct(F.array_position(F.array(*map(F.lit, keys)), F.col("key")).alias("rank"), (-F.col("node")).alias("late"), "pointer")))["pointer"]
    above = F.expr("left(pointer, length(pointer) - length(substring_index(pointer, '/', -1)) - 1)")
    named = fields.groupBy("source_id", "parent").agg(F.max(above).alias("pointer"), *[best(keys).alias(name) for name, keys in names.items()])
    made = [("relation.value_unit_owner", ["value", "unit", "owner"]), ("relation.event_timestamp", ["pointer", "time"]), ("relation.event_trace", ["pointer", "trace"])]
    some = [F.when(~F.exists(F.array(*ends), F.isnull), F.struct(F.lit(name).alias("relation"), F.array(*ends).alias("ends"))) for name, ends in made]
    return named.select("source_id", "pointer", F.explode(F.array_compact(F.array(*some))).alias("r")).select("source_id", "r.relation", "pointer", "r.ends")


def object_arrays(nodes: DataFrame) -> DataFrame:
    """(source_id, node, pointer, rows): arrays that hold objects only, and at least one."""
    return nodes.filter("kind = 'array' and objects = size and size > 0").select("source_id", "node", "pointer", F.col("size").alias("rows"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_parsed(order_json(spark, sf_dir))


def json_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose JSON has a key twice, an open bracket or a number that is none."""
    return json_failures(_parsed(spark, sf_dir))


def json_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every obligation of paths and keys, by path with indices of arrays left out: how many and where they begin and end, summed up."""
    return path_sums(json_node_lists(_parsed(spark, sf_dir)))


def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed leaves with their places."""
    return typed_leaves(json_nodes(_parsed(spark, sf_dir))).select("source_id", "class", "pointer", "kind", "value", "start", "end")


def json_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that deviate from their peers or name a failure."""
    return anomalous_rows(json_nodes(_parsed(spark, sf_dir)))


def json_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value, unit and owner; objects and their trace: by the pointers of their ends."""
    return object_relations(json_nodes(_parsed(spark, sf_dir))).select("source_id", "relation", "pointer", F.concat_ws(" ", "ends").alias("ends"))


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return object_arrays(json_nodes(_parsed(spark, sf_dir))).select("source_id", "pointer", "rows")


# v: an order's items with what stands before each; good: texts that are JSON.
_T = ORDER_ITEMS_SQL + """, v as (select k, nth, item, value, failed, count(*) over (partition by k) as m, cast(length(head) + coalesce(sum(length(item) + 1) over (partition by k order by nth rows between unbounded preceding and 1 preceding), 0) as bigint) as at_, owner,
    length(bom) as b, cast(length(head) + sum(length(item) + 1) over (partition by k) - 1 as bigint) as stop from i where k % 11 <> 0 and k % 13 <> 0 and k % 17 <> 0), o as (select distinct k, b, m, stop from v),
    f as (select k, nth, p, at_, item, x[1] as key, x[2] as kind, x[3] as raw, strpos(item, '"' || key || '"') - 1 as key_at, strpos(item[key_at + 1 :], ':') as colon, key_at + colon + strpos(item[key_at + colon + 1 :], raw) - 1 as val_at from (select k, nth, '/records/' || (nth - 1) as p, at_, item, unnest([('id', 'integer', cast(nth as varchar)), ('value', case when nth % 2 = 0 then 'number' else 'integer' end, value), ('unit', 'string', '"pieces"'), ('owner', 'string', '"' || owner || '"'), ('status', 'string', case when failed then '"request failed"' else '"ok"' end),
        ('share', 'string', case when nth % 4 = 0 then '" 12% "' end), ('tags', 'array', case when nth % 4 = 0 then '[true,null,{"k/~":[1.50]}]' end), ('trace_id', 'string', case when nth % 4 = 0 then '"t\\u00e9"' end)]) as x from v) where x[3] is not null),
    n as (select k, p || '/' || key as pointer, key, case when kind in ('string', 'number', 'integer') then 'value' else kind end as what, kind, raw, at_ + val_at as s, at_ + val_at + length(raw) as e, at_ + key_at as ks, at_ + key_at + length(key) + 2 as ke from f
        union all select k, '/records/' || (nth - 1), null, 'object', 'object', null, at_, at_ + length(item), null, null from v
        union all select k, '/records', 'records', 'array', 'array', null, b + 25 + length(cast(k as varchar)), stop + 1, b + 15 + length(cast(k as varchar)), b + 24 + length(cast(k as varchar)) from o
        union all select k, '', null, 'object', 'object', null, b, stop + 2, null, null from o
        union all select k, '/a~1b', 'a/b', 'object', 'object', null, b + 7, b + 14 + length(cast(k as varchar)), b + 1, b + 6 from o
        union all select k, '/a~1b/~0n', '~n', 'value', 'integer', cast(k as varchar), b + 13, b + 13 + length(cast(k as varchar)), b + 8, b + 12 from o
        union all select k, p || '/tags/' || (x[1]), x[2], x[3], x[4], x[5], at_ + val_at + x[6], at_ + val_at + x[6] + x[7], case when x[2] is not null then at_ + val_at + x[6] - 6 end, case when x[2] is not null then at_ + val_at + x[6] - 1 end from (select *, unnest([('0', null, 'boolean', 'boolean', 'true', 1, 4), ('1', null, 'null', 'null', 'null', 6, 4), ('2', null, 'object', 'object', null, 11, 14), ('2/k~1~0', 'k/~', 'array', 'array', null, 18, 6), ('2/k~1~0/0', null, 'value', 'number', '1.50', 19, 4)]) as x from (select k, p, at_, val_at from f where key = 'tags')))"""
SQL = {
    "json_rejected": "select distinct l_orderkey as source_id, 'INVALID_JSON' as code from lineitem where l_orderkey % 11 = 0 or l_orderkey % 13 = 0 or l_orderkey % 17 = 0",
    "json_structure": _T + """ select regexp_replace(pointer, '/[0-9]+(/|$)', '/[]\\1', 'g') as path, what, count(*) as n, count(distinct k) as sources, cast(sum(s) as bigint) as starts, cast(sum(e) as bigint) as ends from (select k, pointer, what, s, e from n union all select k, pointer, 'key', ks, ke from n where key is not null) group by 1, 2""",
    "json_leaves": _T + """ select k as source_id, class, pointer, kind, case when kind = 'string' then replace(raw[2 : -2], '\\u00e9', 'é') else raw end as value, s as start, e as "end" from (select *, unnest([case when kind in ('integer', 'number') then 'numeric.number' end, case when key = 'share' then 'numeric.percentage' end, case key when 'unit' then 'numeric.unit' when 'owner' then 'identifier.generic' when 'trace_id' then 'identifier.trace_request' end]) as class from n) where class is not null""",
    "json_anomalies": _T + """, g as (select *, bool_or(nth % 4 = 0) over (partition by k) and nth % 4 <> 0 as lacks, min(failed) over w <> max(failed) over w and failed = last_value(failed) over u as s, min(owner) over w <> max(owner) over w and owner = last_value(owner) over u as o, bool_or(value is not null) over w and value is null as nv,
        count(distinct value) over (partition by k) > 1 and value = last_value(value ignore nulls) over u as lv from v window w as (partition by k), u as (partition by k order by nth rows between unbounded preceding and unbounded following))
        select k as source_id, '/records/' || (nth - 1) as pointer, at_ as start, at_ + length(item) as "end", peer, failed as status from (select *, lacks or s or o or nv or coalesce(lv, false) or nth = m as peer from g where m >= 2) where peer or failed""",
    "json_relations": _T + """ select k as source_id, 'relation.value_unit_owner' as relation, '/records/' || (nth - 1) as pointer, '/records/' || (nth - 1) || '/value /records/' || (nth - 1) || '/unit /records/' || (nth - 1) || '/owner' as ends from v where value is not null
        union all select k, 'relation.event_trace', '/records/' || (nth - 1), '/records/' || (nth - 1) || ' /records/' || (nth - 1) || '/trace_id' from v where nth % 4 = 0""",
    "json_arrays": _T + " select k as source_id, '/records' as pointer, m as rows from o",
}
