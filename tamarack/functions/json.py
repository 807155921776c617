"""JSON and canonical JSONB functions.

Reading a path is done by built-in functions where they can say it.  Editing documents,
canonical form and containment have no built-in equivalent; they are pandas functions over
Arrow batches.  Canonical form: keys sorted, the last of equal keys wins, numbers exact and
without exponent, no minus zero, no white space.
"""

from __future__ import annotations

import functools
import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r'\.("(?:[^"\\]|\\.)*"|[^.\[\]]+)|\[(#(?:-\d+)?|-?\d+|"(?:[^"\\]|\\.)*")\]')


def load(text: str):
    return json.loads(text, parse_float=Decimal, parse_int=int)


def dump(x, sort: bool = True) -> str:
    if isinstance(x, bool) or x is None:
        return {True: "true", False: "false", None: "null"}[x]
    if isinstance(x, (int, Decimal, float)):
        text = format(Decimal(x) if not isinstance(x, float) else Decimal(repr(x)), "f")
        text = text.rstrip("0").rstrip(".") if "." in text else text
        return "0" if text in ("-0", "") else text
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, list):
        return "[" + ",".join(dump(e, sort) for e in x) + "]"
    return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v, sort)}" for k, v in (sorted(x.items()) if sort else x.items())) + "}"


def path(text: str) -> list:
    """Steps of a $ path: keys, positions, negative positions, or '#' for the end."""
    if not text.startswith("$"):
        raise ValueError(f"bad JSON path: {text}")
    steps, at = [], 1
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise ValueError(f"bad JSON path: {text}")
        key, place = m[1], m[2]
        if key is not None:
            steps.append(json.loads(key) if key.startswith('"') else key)
        elif place.startswith('"'):
            steps.append(json.loads(place))
        elif place.startswith("#"):
            steps.append("#" if place == "#" else int(place[1:]))
        else:
            steps.append(int(place))
        at = m.end()
    return steps


class Missing(Exception):
    pass


def get(x, steps: list):
    for s in steps:
        if isinstance(x, dict) and isinstance(s, str):
            if s not in x:
                raise Missing
            x = x[s]
        elif isinstance(x, list) and (isinstance(s, int) or isinstance(s, str) and re.fullmatch(r"-?\d+", s)):
            s = int(s)
            if not -len(x) <= s < len(x):
                raise Missing
            x = x[s]
        else:
            raise Missing
    return x


def edit(x, steps: list, value, insert: bool, replace: bool):
    """Sets what the path names: only if missing (insert), only if there (replace), or both."""
    if not steps:
        return value if replace else x
    try:
        holder = get(x, steps[:-1])
    except Missing:
        return x
    last = steps[-1]
    if isinstance(holder, list) and isinstance(last, str) and re.fullmatch(r"-?\d+", last):
        last = int(last)
    if isinstance(holder, dict) and isinstance(last, str):
        if replace if last in holder else insert:
            holder[last] = value
    elif isinstance(holder, list):
        if last == "#" or last == len(holder):
            if insert:
                holder.append(value)
        elif isinstance(last, int) and -len(holder) <= last < len(holder) and replace:
            holder[last] = value
    return x


def remove(x, steps: list):
    if not steps:
        return None
    try:
        holder = get(x, steps[:-1])
        get(holder, steps[-1:])
    except Missing:
        return x
    del holder[steps[-1] if isinstance(holder, dict) else int(steps[-1])]
    return x


def holds(a, b, top: bool = True) -> bool:
    """a @> b."""
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and holds(a[k], v, False) for k, v in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(holds(x, y, False) for x in a) for y in b)
    if top and isinstance(a, list) and not isinstance(b, (dict, list)):
        return any(_same(x, b) for x in a)
    return _same(a, b)


def _same(a, b) -> bool:
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def strip_nulls(x):
    if isinstance(x, dict):
        return {k: strip_nulls(v) for k, v in x.items() if v is not None}
    return [strip_nulls(v) for v in x] if isinstance(x, list) else x


def pretty(x, depth: int = 0) -> str:
    pad, end = "    " * (depth + 1), "    " * depth
    if isinstance(x, dict) and x:
        return "{\n" + ",\n".join(f"{pad}{json.dumps(k, ensure_ascii=False)}: {pretty(v, depth + 1)}" for k, v in sorted(x.items())) + f"\n{end}}}"
    if isinstance(x, list) and x:
        return "[\n" + ",\n".join(pad + pretty(v, depth + 1) for v in x) + f"\n{end}]"
    return dump(x)


def merge(a, b):
    """The double bar: objects merge, arrays join, other values count as one-element arrays."""
    if isinstance(a, dict) and isinstance(b, dict):
        return a | b
    return (a if isinstance(a, list) else [a]) + (b if isinstance(b, list) else [b])


def minus(x, what):
    """Deletes a key, strings of an array, or an element by its position."""
    if isinstance(what, list):
        for w in what:
            x = minus(x, w)
        return x
    if isinstance(what, int):
        if not isinstance(x, list):
            raise ValueError("cannot delete from object using integer index")
        return [e for i, e in enumerate(x) if i != (what if what >= 0 else what + len(x))]
    return {k: v for k, v in x.items() if k != what} if isinstance(x, dict) else [e for e in x if e != what]


def steps_of(text: str) -> list[str]:
    """Steps of a path written as an array of text, such as {a,1,"x y"}."""
    if not (text.startswith("{") and text.endswith("}")):
        raise ValueError(f"bad path: {text}")
    return [json.loads(s) if s.startswith('"') else s.strip() for s in re.findall(r'"(?:[^"\\]|\\.)*"|[^,]+', text[1:-1])]


def _place(holder, step: str):
    """The key, or the position, that a step names in an object or an array."""
    if isinstance(holder, dict):
        return step
    if isinstance(holder, list) and re.fullmatch(r"-?\d+", step):
        return int(step)
    if isinstance(holder, list):
        raise ValueError(f"path element is not an integer: {step}")
    raise Missing


def _at(x, steps: list[str]):
    try:
        return dump(get(x, steps))
    except Missing:
        return None


def without(x, steps: list[str]):
    """Deletes what a path names; a path to nothing changes nothing."""
    try:
        holder = get(x, steps[:-1]) if steps else None
        del holder[_place(holder, steps[-1])]
    except (Missing, KeyError, IndexError, TypeError):
        pass
    return x


def put(x, steps: list[str], value, create: bool):
    """Replaces what a path names; with ``create``, a new key is added, and a position beyond an
    array's ends goes to that end."""
    try:
        holder = get(x, steps[:-1]) if steps else None
        place = _place(holder, steps[-1]) if steps else None
    except Missing:
        return x
    if isinstance(holder, dict) and (create or place in holder):
        holder[place] = value
    elif isinstance(holder, list):
        if -len(holder) <= place < len(holder):
            holder[place] = value
        elif create:
            holder.insert(len(holder) if place >= 0 else 0, value)
    return x


def put_beside(x, steps: list[str], value, after: bool):
    """Inserts into an array before (or after) a position, or a new key into an object."""
    try:
        holder = get(x, steps[:-1]) if steps else None
        place = _place(holder, steps[-1]) if steps else None
    except Missing:
        return x
    if isinstance(holder, dict):
        if place in holder:
            raise ValueError("cannot replace existing key")
        holder[place] = value
    elif isinstance(holder, list):
        place += len(holder) if place < 0 else 0
        holder.insert(min(max(place + after, 0), len(holder)) if place >= 0 else 0, value)
    return x


def _over(fn, kind: str, strict: bool = True):
    """A pandas function over JSON texts; null stays null, and text that is no JSON is an error
    (or null, where it isn't strict)."""

    def one(*xs):
        if any(x is None for x in xs):
            return None
        try:
            return fn(*xs)
        except json.JSONDecodeError:
            if strict:
                raise ValueError("malformed JSON") from None
            return None

    def many(*columns: pd.Series) -> pd.Series:
        return pd.Series([one(*[None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else x for x in xs]) for xs in zip(*columns, strict=True)], dtype=object)

    many.__annotations__ = {"return": pd.Series}
    return F.pandas_udf(many, kind, F.PandasUDFType.SCALAR)


@functools.cache
def _udf(name: str, *args):
    editing = {"set": (True, True), "insert": (True, False), "replace": (False, True)}
    if name == "canonical":
        return _over(lambda t: dump(load(t)), "string")
    if name == "minify":
        return _over(lambda t: dump(load(t), sort=False), "string")
    if name == "valid":
        return _over(lambda t: 0 if _bad(t) else 1, "int", strict=False)
    if name in editing:
        steps, (insert, replace) = path(args[0]), editing[name]
        return _over(lambda t, v: dump(edit(load(t), steps, load(v), insert, replace)), "string")
    if name == "remove":
        ways = [path(a) for a in args]
        return _over(lambda t: (lambda x: None if x is None else dump(x))(functools.reduce(remove, ways, load(t))), "string")
    if name == "contains":
        return _over(lambda a, b: holds(load(a), load(b)), "boolean")
    if name == "strip":
        return _over(lambda t: dump(strip_nulls(load(t))), "string")
    if name == "pretty":
        return _over(lambda t: pretty(load(t)), "string")
    if name == "merge":
        return _over(lambda a, b: dump(merge(load(a), load(b))), "string")
    if name == "minus":
        what = json.loads(args[0])
        return _over(lambda t: dump(minus(load(t), what)), "string")
    if name == "extract":
        ways = [path(a) for a in args]
        return _over(lambda t: _extract(load(t), ways), "string")
    if name == "type":
        steps = path(args[0])
        return _over(lambda t: _kind(load(t), steps), "string")
    if name == "keys":
        return _over(lambda t: _keys(load(t)), "array<string>")
    if name == "at":
        return _over(lambda t, p: _at(load(t), steps_of(p)), "string")
    if name == "without":
        return _over(lambda t, p: dump(without(load(t), steps_of(p))), "string")
    if name == "put":
        return _over(lambda t, p, v, create: dump(put(load(t), steps_of(p), load(v), bool(create))), "string")
    if name == "put_beside":
        return _over(lambda t, p, v, after: dump(put_beside(load(t), steps_of(p), load(v), bool(after))), "string")
    raise ValueError(name)


def _bad(text: str) -> bool:
    try:
        load(text)
    except ValueError:
        return True
    return False


def _extract(x, ways: list):
    """JSON text of what one path names; of several, an array with null for what is missing."""
    out = []
    for way in ways:
        try:
            out.append(get(x, way))
        except Missing:
            if len(ways) == 1:
                return None
            out.append(None)
    return dump(out if len(ways) > 1 else out[0])


def _kind(x, steps: list):
    try:
        x = get(x, steps)
    except Missing:
        return None
    if isinstance(x, bool) or x is None:
        return {True: "true", False: "false", None: "null"}[x]
    return {int: "integer", Decimal: "real", str: "text", list: "array", dict: "object"}[type(x)]


def _keys(x) -> list[str]:
    return sorted(x) if isinstance(x, dict) else [e for e in x if isinstance(e, str)] if isinstance(x, list) else [x] if isinstance(x, str) else []


def canonical(doc: Column) -> Column:
    """::jsonb."""
    return _udf("canonical")(doc)


def minify(doc: Column) -> Column:
    return _udf("minify")(doc)


def valid(doc: Column) -> Column:
    return _udf("valid")(doc)


def json_type(doc: Column, at: str = "$") -> Column:
    return _udf("type", at)(doc)


def extract(doc: Column, *paths: str) -> Column:
    """The -> operator: JSON text of what the path names."""
    return _udf("extract", *paths)(doc)


def extract_text(doc: Column, at: str) -> Column:
    """The ->> operator: SQL text of what the path names."""
    return F.get_json_object(doc, at)


def json_set(doc: Column, at: str, value: Column) -> Column:
    """Value is JSON text; quote() makes it from SQL text."""
    return _udf("set", at)(doc, value)


def json_insert(doc: Column, at: str, value: Column) -> Column:
    return _udf("insert", at)(doc, value)


def json_replace(doc: Column, at: str, value: Column) -> Column:
    return _udf("replace", at)(doc, value)


def json_remove(doc: Column, *paths: str) -> Column:
    return _udf("remove", *paths)(doc)


def array_length(doc: Column) -> Column:
    return F.coalesce(F.json_array_length(doc), F.lit(0))


def quote(text: Column) -> Column:
    """JSON_QUOTE of text."""
    return F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'^\{"x":([\s\S]*)\}$', 1)


def contains(a: Column, b: Column) -> Column:
    return _udf("contains")(a, b)


def keys(doc: Column) -> Column:
    return _udf("keys")(doc)


def has_key(doc: Column, key: str) -> Column:
    return F.array_contains(keys(doc), key)


def has_any_key(doc: Column, *names: str) -> Column:
    return F.arrays_overlap(keys(doc), F.array(*map(F.lit, names)))


def has_all_keys(doc: Column, *names: str) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, names)), keys(doc))) == 0


def concat(a: Column, b: Column) -> Column:
    return _udf("merge")(a, b)


def minus_key(doc: Column, what) -> Column:
    return _udf("minus", json.dumps(what))(doc)


def strip(doc: Column) -> Column:
    return _udf("strip")(doc)


def pretty_text(doc: Column) -> Column:
    return _udf("pretty")(doc)


# JSONB with paths as arrays of text
def _path(steps) -> Column:
    return F.lit("{" + ",".join(str(s) if re.fullmatch(r"-?\w+", str(s)) else json.dumps(str(s), ensure_ascii=False) for s in steps) + "}")


def at_path(doc: Column, *steps) -> Column:
    """The operators -> (one step) and #>: canonical JSON of what the path names."""
    return _udf("at")(doc, _path(steps))


def text_at_path(doc: Column, *steps) -> Column:
    """The operators ->> and #>>: a string as its text, null for null, other values as JSON."""
    found = at_path(doc, *steps)
    return F.when(found.startswith('"'), F.get_json_object(found, "$")).when(found != "null", found)


def delete_path(doc: Column, *steps) -> Column:
    """The operator #-."""
    return _udf("without")(doc, _path(steps))


def set_path(doc: Column, steps, value: Column, create: bool = True) -> Column:
    """JSONB_SET with a path as an array of text; the value is JSON."""
    return _udf("put")(doc, _path(steps), value, F.lit(create))


def insert_path(doc: Column, steps, value: Column, after: bool = False) -> Column:
    """JSONB_INSERT with a path as an array of text; a key that is there is an error."""
    return _udf("put_beside")(doc, _path(steps), value, F.lit(after))


def to_jsonb(value: Column) -> Column:
    """JSON of a value of any type, with nulls inside; null stays null."""
    whole = F.to_json(F.struct(value.alias("x")), {"ignoreNullFields": "false"})
    return F.when(value.isNotNull(), F.regexp_extract(whole, r'^\{"x":([\s\S]*)\}$', 1))


def jsonb_typeof(doc: Column) -> Column:
    """object, array, string, number, boolean or null; malformed text is an error."""
    first = F.substring(F.to_json(F.parse_json(doc)), 1, 1)
    kinds = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
    out = F.when(first.isNull(), None)
    for mark, kind in kinds.items():
        out = out.when(first == mark, kind)
    return out.otherwise("number")


def register(spark) -> None:
    """The functions over paths for statements of the dialect, whose paths are values."""
    for name, of in (("jsonb_delete_path", "without"), ("jsonb_set_path", "put"), ("jsonb_insert_path", "put_beside")):
        spark.udf.register(name, _udf(of))
