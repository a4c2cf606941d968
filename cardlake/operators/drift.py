"""Schemas that drift from file to file: tagged-union inference, one consistent table, a row per change.

Every value is tagged with its JSON type, so a path that is a number here and a text there keeps both alternatives.
Per (file, path, type) a fixed-size profile is aggregated map-side; comparing files touches profiles only.
"""

from __future__ import annotations

from collections import Counter
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.actions import let

#: Number of minimum hashes kept of a field's values.
HASHES = 12
#: Least likeness of two value profiles for a rename.
RENAME_LIKENESS = 0.5


def _fields(body: Column, nested: tuple[str, ...]) -> Column:
    """ARRAY<STRUCT<path, value>> of one line: its top-level keys, and the keys inside the ``nested`` objects as object.key
    in place of the object. Null for a line that is no JSON object."""
    v = F.try_parse_json(body)
    entries = lambda x: F.map_entries(F.try_variant_get(x, "$", "map<string,variant>"))
    as_field = lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value"))

    def split(all_of: Column) -> Column:
        plain = F.transform(F.filter(all_of, lambda e: ~e["key"].isin(*nested)), as_field)
        return F.concat(plain, *[_inside(all_of, k) for k in nested])

    def _inside(all_of: Column, key: str) -> Column:
        objects = F.filter(all_of, lambda e: (e["key"] == key) & F.schema_of_variant(e["value"]).startswith("OBJECT"))
        inner = F.flatten(F.transform(objects, lambda e: entries(e["value"])))
        return F.transform(inner, lambda e: F.struct(F.concat(F.lit(key + "."), e["key"]).alias("path"), e["value"].alias("value")))

    return F.when(F.schema_of_variant(v).startswith("OBJECT"), let(entries(v), split))


def _kind(shape: Column) -> Column:
    return (
        F.when(shape == "VOID", F.lit(None).cast("string"))
        .when(shape.startswith("OBJECT"), "object")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "STRING", "string")
        .otherwise("number")
    )


def field_values(lines: DataFrame, nested: tuple[str, ...] = ("decision",)) -> DataFrame:
    """One row per (line, path) with the value as a variant. Lines that are not a JSON object (cut, empty, null, arrays,
    scalars) give no rows. Keys inside the ``nested`` objects appear as ``object.key``; the nested object itself does not."""
    keep = [c for c in lines.columns if c != "body"]
    return lines.select(*keep, F.explode(_fields(F.col("body"), nested)).alias("__f")).select(*keep, F.col("__f.path").alias("path"), F.col("__f.value").alias("value"))


def tagged(values: DataFrame) -> DataFrame:
    """The values with their JSON ``kind`` (null for JSON null), their ``shape`` and their ``text``."""
    keep = [c for c in values.columns if c != "value"]
    d = values.withColumn("shape", F.schema_of_variant("value"))
    return d.select(*keep, _kind(F.col("shape")).alias("kind"), "shape", F.try_variant_get(F.col("value"), "$", "string").alias("text"))


def tagged_values(lines: DataFrame, nested: tuple[str, ...] = ("decision",)) -> DataFrame:
    """One row per (line, path): ``path``, JSON ``kind`` (null for JSON null), ``shape`` and the value as ``text``."""
    return tagged(field_values(lines, nested))


#: Kinds of JSON values, each a bit of a field's set of types.
KINDS = ("array", "boolean", "number", "object", "string")


def file_fields(values: DataFrame, file_key: list[str]) -> DataFrame:
    """Per file and path: the set of types, the values and how many of them are filled. Fixed-width buffers throughout."""
    kind = _kind(F.schema_of_variant("value"))
    d = values.select(*file_key, "path", kind.alias("kind"))
    bit = F.coalesce(*[F.when(F.col("kind") == k, 1 << i) for i, k in enumerate(KINDS)], F.lit(0))
    g = d.groupBy(*file_key, "path").agg(F.bit_or(bit).alias("bits"), F.count("*").alias("n"), F.count("kind").alias("filled"))
    kinds = F.array_compact(F.array(*[F.when(F.col("bits").bitwiseAND(1 << i) > 0, F.lit(k)) for i, k in enumerate(KINDS)]))
    return g.select(*file_key, "path", kinds.alias("kinds"), "n", "filled")


def file_profiles(tagged: DataFrame, file_key: list[str]) -> DataFrame:
    """Per file and path a fixed-size profile of the values: minimum hashes, magnitudes and shares of character classes."""
    word = F.when(F.col("kind") == "string", F.col("text"))
    share = lambda pattern: F.regexp_count(word, F.lit(pattern)) / F.greatest(F.length("text"), F.lit(1))
    d = tagged.select(
        *file_key, "path",
        F.when(F.col("kind").isNotNull(), F.xxhash64(F.when(F.col("kind").isin("object", "array"), F.col("shape")).otherwise(F.col("text")))).alias("h"),
        F.when(F.col("kind") == "number", F.col("text").try_cast("double")).alias("num"), F.when(word.isNotNull(), F.log1p(F.length("text").cast("double"))).alias("len"),
        share("[0-9]").alias("digits"), share("[A-Z]").alias("capitals"), share(r"\s").alias("spaces"), share(r"[^0-9A-Za-z\s]").alias("marks"),
    )
    num = F.col("num")
    return d.groupBy(*file_key, "path").agg(
        F.array(*[F.min(F.when(F.col("h").isNotNull(), F.xxhash64("h", F.lit(i)))) for i in range(HASHES)]).alias("sketch"),
        F.struct(
            F.avg(F.signum(num) * F.log1p(F.abs(num))).alias("magnitude"),
            F.stddev_pop(F.log1p(F.abs(num))).alias("spread"),
            F.avg(F.when(num.isNotNull(), F.when(num == F.floor(num), 1.0).otherwise(0.0))).alias("whole"),
            F.avg("len").alias("length"),
            *[F.avg(c).alias(c) for c in ("digits", "capitals", "spaces", "marks")],
        ).alias("profile"),
    )


def _likeness(a: str, b: str):
    """(score, name): how likely two profiles describe one field. The score is the likeness of the values, raised when
    both fields are filled in every record of their files or one name contains the words of the other; ``name``, the
    likeness of the spelling, only breaks near ties."""
    same = sum(F.when(F.get(F.col(f"{a}.sketch"), F.lit(i)) == F.get(F.col(f"{b}.sketch"), F.lit(i)), 1.0).otherwise(0.0) for i in range(HASHES)) / HASHES

    def gap(f, weight):
        x, y = F.col(f"{a}.profile.{f}"), F.col(f"{b}.profile.{f}")
        return F.when(x.isNull() & y.isNull(), 0.0).when(x.isNull() | y.isNull(), 0.2).otherwise(F.abs(x - y) * weight)

    far = gap("magnitude", 0.7) + gap("spread", 0.7) + gap("whole", 3.0) + gap("length", 1.5) + gap("digits", 4.0) + gap("capitals", 4.0) + gap("spaces", 8.0) + gap("marks", 5.0)
    shared = F.arrays_overlap(F.col(f"{a}.kinds"), F.col(f"{b}.kinds"))
    form = F.when(F.arrays_overlap(F.col(f"{a}.kinds"), F.array(F.lit("number"), F.lit("string"))), F.exp(-far)).otherwise(F.lit(0.0))
    plain = lambda c: F.lower(F.regexp_replace(F.col(f"{c}.path"), "[^A-Za-z0-9.]", ""))
    name = F.lit(1.0) - F.levenshtein(plain(a), plain(b)) / F.greatest(F.length(plain(a)), F.length(plain(b)))
    full = lambda c: F.col(f"{c}.filled") == F.col(f"{c}.records")
    always = F.when(full(a) & full(b), 0.15).when(full(a) | full(b), -0.1).otherwise(0.0)
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(F.substring_index(F.col(f"{c}.path"), ".", -1), "([a-z0-9])([A-Z])", "$1_$2")), "_"), lambda w: w != "")
    wa, wb = words(a), words(b)
    contains = (F.size(F.array_except(wa, wb)) == 0) | (F.size(F.array_except(wb, wa)) == 0)
    return F.when(shared, F.greatest(same, form) + always + F.when(contains, 0.4).otherwise(0.0)).otherwise(0.0), name


def preceding_files(files: DataFrame, series: str, at: str, name: str) -> DataFrame:
    """Adds ``before``, the preceding file of the same series. Months are sorted on their own, so a series that holds
    a third of all files is no single task."""
    from .sequence import with_previous

    month = F.year(at) * 12 + F.month(at)
    return with_previous(files, [series], [at, name], month, [name], prefix="before_").withColumnRenamed(f"before_{name}", "before")


def schema_changes(lines: DataFrame, likeness: float = RENAME_LIKENESS) -> DataFrame:
    """(fileName, field, change) of every file against its exporter's preceding file.

    ``lines`` has fileName, exporter, exportedAt and body. Files without any valid record have no fields: all fields
    of the next file are compared with the preceding file that has records. A gone field is ``renamed`` when a new
    field on its level shares a type with it and is its best and mutually best match of at least ``likeness``;
    otherwise both are reported. Ties fall to the closer name, then the alphabetically first.
    """
    key = ["exporter", "exportedAt", "fileName"]
    values = field_values(lines.select(*key, "body"))
    prof = file_fields(values, key)
    prof = _cached(prof.withColumn("records", F.max("n").over(W.partitionBy("fileName"))))
    files = prof.select(*key).distinct()
    pairs = preceding_files(files, "exporter", "exportedAt", "fileName").filter("before IS NOT NULL").select("fileName", "before")
    one = F.struct("kinds", "filled", "records").alias("x")
    old = pairs.join(prof.select(F.col("fileName").alias("before"), "path", one), "before").select("fileName", "path", "before", F.col("x").alias("a"))
    new = pairs.join(prof.select("fileName", "path", one), "fileName").select("fileName", "path", F.col("x").alias("b"))
    both = _cached(old.join(new, ["fileName", "path"], "full_outer"))
    retyped = both.filter("a IS NOT NULL AND b IS NOT NULL AND size(a.kinds) > 0 AND size(b.kinds) > 0 AND a.kinds <> b.kinds").select("fileName", F.col("path").alias("field"), F.lit("retyped").alias("change"))
    level = lambda c: F.when(F.col(c).contains("."), F.substring_index(F.col(c), ".", 1)).otherwise("")
    gone = both.filter("b IS NULL").select("fileName", "before", F.col("path").alias("field"), "a", level("path").alias("level"))
    came = both.filter("a IS NULL").select("fileName", F.col("path").alias("as"), "b", level("path").alias("level"))
    # only fields that went where others came on their level can be renamed: only their values are profiled
    cand = gone.join(came, ["fileName", "level"])
    touched = cand.select(F.col("before").alias("fileName"), F.col("field").alias("path")).unionByName(cand.select("fileName", F.col("as").alias("path"))).distinct()
    profile = _cached(file_profiles(tagged(values.select("fileName", "path", "value").join(touched, ["fileName", "path"])), ["fileName"]))
    seen = lambda x, f, p: profile.select(F.col("fileName").alias(f), F.col("path").alias(p), F.struct("sketch", "profile").alias(f"p{x}"))
    cand = cand.join(seen("a", "before", "field"), ["before", "field"]).join(seen("b", "fileName", "as"), ["fileName", "as"])
    side = lambda x, path: F.struct(F.col(path).alias("path"), f"{x}.kinds", f"{x}.filled", f"{x}.records", f"p{x}.sketch", f"p{x}.profile").alias(x)
    cand = cand.select("fileName", "field", "as", side("a", "field"), side("b", "as"))
    score, name = _likeness("a", "b")
    cand = cand.select("fileName", "field", "as", score.alias("score"), name.alias("name")).filter(F.col("score") >= likeness)
    rank = F.struct((-F.round("score", 2)).alias("s"), (-F.col("name")).alias("n"), F.col("field"), F.col("as"))
    best = cand.withColumn("__r", rank)
    best = best.withColumn("__f", F.min("__r").over(W.partitionBy("fileName", "field"))).withColumn("__t", F.min("__r").over(W.partitionBy("fileName", "as")))
    renamed = best.filter("__r = __f AND __r = __t").select("fileName", "field", "as")
    lost = gone.select("fileName", "field").join(renamed.select("fileName", "field"), ["fileName", "field"], "left_anti").withColumn("change", F.lit("removed"))
    added = came.select("fileName", F.col("as").alias("field")).join(renamed.select("fileName", F.col("as").alias("field")), ["fileName", "field"], "left_anti").withColumn("change", F.lit("added"))
    out = renamed.select("fileName", "field", F.lit("renamed").alias("change"), F.col("as").alias("successor"))
    none = F.lit(None).cast("string").alias("successor")
    for x in (lost, added, retyped):
        out = out.unionByName(x.select("fileName", "field", "change", none))
    return out


def _cached(df: DataFrame) -> DataFrame:
    from ..session import cut

    return cut(df)


#: Most renames of single files that may be fused; more are refused rather than collected.
RENAMES = 1_000_000
#: Exporters that must rename one name to another before it holds for those that do not.
AGREE = 2


def _order(r) -> tuple:
    return (r["exportedAt"] is not None, r["exportedAt"], r["fileName"])


def canonical_spans(lines: DataFrame) -> tuple[list[tuple], dict[str, str]]:
    """Rows (exporter, path, since, until, name), which field is called otherwise in an exporter's files from ``since`` to
    before ``until``, both (exportedAt, fileName) or null where the span is open; and the names that hold elsewhere.

    A rename holds for its exporter from its file on; names that follow each other there are one field. Two names are one
    for the other exporters too when ``AGREE`` exporters rename one to the other. The canonical name is the one found in
    most records of the corpus, then the alphabetically first. Names that occur together in any record of the corpus are
    two fields and never joined. Renames (``RENAMES`` at most, checked) and the sets of renamed names that occur together
    reach the driver.
    """
    found = schema_changes(lines).filter("change = 'renamed'").select("fileName", "field", "successor")
    events = lines.select("exporter", "exportedAt", "fileName").distinct().join(found, "fileName").limit(RENAMES + 1).collect()
    if len(events) > RENAMES:
        raise ValueError(f"more than {RENAMES} renames")
    if not events:
        return [], {}
    renamed = sorted({x for r in events for x in (r["field"], r["successor"])})
    paths = lines.select(F.transform(_fields(F.col("body"), ("decision",)), lambda x: x["path"]).alias("p")).filter("p IS NOT NULL")
    shapes = paths.select(F.array_sort(F.array_intersect("p", F.array(*[F.lit(x) for x in renamed]))).alias("paths")).groupBy("paths").agg(F.count("*").alias("n")).collect()
    seen: dict[str, int] = {}
    beside: dict[str, set[str]] = {}
    for r in shapes:
        for x in r["paths"]:
            seen[x] = seen.get(x, 0) + r["n"]
            beside.setdefault(x, set()).update(r["paths"])
    now: dict[tuple, list] = {}  # (exporter, path) -> the field's stretches [path, since, until]
    fields = []
    events.sort(key=lambda r: (r["exporter"] is not None, r["exporter"], _order(r), r["field"]))
    for _, group in groupby(events, key=lambda r: (r["exporter"], r["exportedAt"], r["fileName"])):
        moved = {}
        for r in group:
            at, old, new = (r["exportedAt"], r["fileName"]), r["field"], r["successor"]
            own = now.pop((r["exporter"], old), None)
            if own is None:
                own = [(r["exporter"], old, None, None)]
                fields.append(own)
            *rest, (e, path, since, _) = own
            own[:] = [*rest, (e, path, since, at)]
            if any(new in beside.get(x[1], ()) and x[1] != new for x in own):
                own = []
                fields.append(own)
            own.append((r["exporter"], new, at, None))
            moved[r["exporter"], new] = own
        now |= moved
    most = lambda n: (-seen.get(n, 0), n)
    everywhere = _agreed(events, beside, most)
    out = []
    for own in fields:
        best = min((everywhere.get(x[1], x[1]) for x in own), key=most)
        out += [(*x, best) for x in own if best != everywhere.get(x[1], x[1])]
    return out, everywhere


def _agreed(events: list, beside: dict[str, set[str]], most) -> dict[str, str]:
    """The canonical names that hold for every exporter; the renames of most exporters are joined first."""
    by: dict[tuple, set] = {}
    for r in events:
        by.setdefault(tuple(sorted((r["field"], r["successor"]))), set()).add(r["exporter"])
    group: dict[str, set[str]] = {}
    for a, b in sorted((p for p, who in by.items() if len(who) >= AGREE), key=lambda p: (-len(by[p]), p)):
        x, y = group.get(a, {a}), group.get(b, {b})
        if x is not y and not any(n in beside.get(m, ()) for m in x for n in y):
            for n in (both := x | y):
                group[n] = both
    return {n: min(names, key=most) for n, names in group.items()}


def canonical_names(lines: DataFrame) -> dict[str, str]:
    """Every renamed field's canonical name, whatever the exporter and file; of several the one given most often, then the
    alphabetically first."""
    spans, out = canonical_spans(lines)
    given = Counter((path, name) for _, path, _, _, name in spans)
    out = {name: name for _, name in given} | out
    for path, name in sorted(given, key=lambda x: (-given[x], x[1])):
        out[path] = name if out.get(path, path) == path else out[path]
    return out


def _one_name_each(fields):
    """Column: (name, value) of one record's (path, name, value). A field takes its canonical name unless a filled field
    bears it already; of several the filled one wins, then the alphabetically first. A filled field that does not win
    keeps its own name; an empty one is left out then, as its canonical name is there. Of equal paths (a key that itself
    has a dot) one is kept, a filled one first."""
    turned = F.reverse(fields)
    fields = F.filter(turned, lambda x, i: F.array_position(F.transform(turned, lambda y: y["path"]), x["path"]) == i + 1)
    filled = F.transform(F.filter(fields, lambda x: x["value"]["kind"].isNotNull()), lambda x: x["path"])
    may = lambda x: (x["path"] == x["name"]) | ~F.array_contains(filled, x["name"])
    rank = lambda x: F.struct(x["value"]["kind"].isNull(), x["path"] != x["name"], x["path"])
    wins = lambda x: may(x) & ~F.exists(fields, lambda y: may(y) & (y["name"] == x["name"]) & (rank(y) < rank(x)))
    named = F.transform(fields, lambda x: F.struct(wins(x).alias("won"), x.alias("x")))
    kept = F.filter(named, lambda y: y["won"] | y["x"]["value"]["kind"].isNotNull())
    return F.transform(kept, lambda y: F.struct(F.when(y["won"], y["x"]["name"]).otherwise(y["x"]["path"]).alias("name"), y["x"]["value"].alias("value")))


def fused_records(lines: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """One consistent table of all valid records: exporter, fileName, lineNo and ``fields``, a map from canonical name
    to a tagged union: kind, then the branches text, number, flag and json of which the kind's own one is set, and
    ``canonical``, the value as text whatever its type (numbers in plain decimal form, so "4" and 4 agree).

    Invalid lines give no record, equal lines one each; a record is rebuilt inside its row, without a shuffle of its
    values. A field that is null keeps its name with kind null. Canonical names hold for an
    exporter's span of files (``canonical_spans``), or everywhere where ``names`` are given. When two names of one record
    have the same canonical name, the canonical one wins if it is filled, then a filled one; the others keep their own.
    """
    whole = lines.filter(F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT"))
    d = whole.select("exporter", "exportedAt", "fileName", "lineNo", _fields(F.col("body"), ("decision",)).alias("f"))
    d = d.withColumn("renamed", F.lit(None).cast("map<string,string>"))
    if names is None:
        spans, names = canonical_spans(lines)
        if spans:
            point = "struct<exportedAt:timestamp,fileName:string>"
            m = lines.sparkSession.createDataFrame(spans, f"exporter string, path string, since {point}, until {point}, name string")
            m = m.select(F.col("exporter").alias("__e"), "path", "since", "until", "name")
            # the names that hold in each file, one map a file
            here = F.struct("exportedAt", "fileName")
            on = F.col("exporter").eqNullSafe(F.col("__e")) & (F.col("since").isNull() | (here >= F.col("since"))) & (F.col("until").isNull() | (here < F.col("until")))
            files = lines.select("exporter", "exportedAt", "fileName").distinct()
            of_file = files.join(m, on).groupBy("exporter", "exportedAt", "fileName").agg(F.map_from_entries(F.collect_set(F.struct("path", "name"))).alias("renamed"))
            same = [d[c].eqNullSafe(of_file[c]) for c in ("exporter", "exportedAt", "fileName")]
            d = d.drop("renamed").join(of_file, same[0] & same[1] & same[2], "left").select(d["exporter"], d["fileName"], d["lineNo"], d["f"], of_file["renamed"])
    everywhere = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else F.create_map().cast("map<string,string>")
    named = F.transform("f", lambda x: F.struct(x["path"].alias("path"), F.coalesce(F.try_element_at(F.col("renamed"), x["path"]), F.try_element_at(everywhere, x["path"]), x["path"]).alias("name"), let(x["value"], _union).alias("value")))

    def record(f: Column) -> Column:
        plainly = F.transform(f, lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
        clash = F.size(F.array_distinct(F.transform(f, lambda x: x["name"]))) < F.size(f)
        return F.array_sort(F.when(clash, _one_name_each(f)).otherwise(plainly))

    # bound once: a column that is named twice would be computed twice
    return d.select("exporter", "fileName", "lineNo", F.map_from_entries(let(F.array_sort(named), record)).alias("fields"))


def _union(v: Column) -> Column:
    """The tagged union of one value."""
    return let(F.struct(_kind(F.schema_of_variant(v)).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")), lambda x: let(x["text"].try_cast("decimal(30,6)"), lambda num: _branches(x["kind"], x["text"], num)))


def _branches(kind: Column, text: Column, num: Column) -> Column:
    plain = F.when(num == F.floor(num), F.floor(num).cast("string")).when(num.isNotNull() & kind.isin("number", "string"), F.regexp_replace(num.cast("string"), r"\.?0+$", "")).otherwise(text)
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "string", text).alias("text"),
        F.when(kind == "number", text.try_cast("double")).alias("number"),
        F.when(kind == "boolean", text.try_cast("boolean")).alias("flag"),
        F.when(kind.isin("object", "array"), text).alias("json"),
        plain.alias("canonical"),
    )
