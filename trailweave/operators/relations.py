"""Relations: the schema tree behind subjects and the links inside payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailweave.functions.paths import (
    ID_SEGMENT, collapse, first_segment, plural_of, reference_stem, reference_suffix, segments,
)
from trailweave.functions.payloads import whole_json
from trailweave.session import cut_lineage

# Every string token of a JSON text, with the string value behind it if it is a key.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_TOKEN = rf"(?s){_STRING}(?:\s*+:\s*+{_STRING})?+"


def subject_tree(log: DataFrame) -> DataFrame:
    """Collapsed paths with events and distinct instances (path, depth, seg, is_id).

    Events are first counted per subject, then instances per (path, segment), so a
    level with a billion instances is counted in parallel.
    """
    per_subject = log.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    parts = segments(F.col("subject"))
    named = per_subject.select(parts.alias("parts"), F.transform(parts, collapse).alias("names"), "n")
    exploded = named.select("names", F.posexplode("parts").alias("i", "raw"), "n").withColumn(
        "seg", F.get("names", F.col("i"))
    )
    steps = exploded.select(
        F.concat(F.lit("/"), F.array_join(F.slice("names", F.lit(1), F.col("i") + 1), "/")).alias("path"),
        # A raw segment that already reads "{id}" is a name, not an instance.
        ((F.col("seg") == ID_SEGMENT) & (F.col("raw") != ID_SEGMENT)).alias("is_id"), "raw", "n",
    )
    # Depth and segment follow from the path; without them a row per instance is half as wide in memory.
    instances = steps.groupBy("path", "is_id", F.when(F.col("is_id"), F.col("raw")).alias("instance")).agg(F.sum("n").alias("n"))
    tree = instances.groupBy("path", "is_id").agg(F.sum("n").alias("events"), F.count("instance").alias("instances"))
    parts = F.split("path", "/")
    return tree.select(
        "path", (F.size(parts) - 1).cast("bigint").alias("depth"), F.element_at(parts, -1).alias("seg"), "is_id", "events", "instances")


def tree_order(tree: DataFrame) -> DataFrame:
    """Adds the place of a node among its siblings: most events first, then by name."""
    parent = F.regexp_extract("path", r"(?s)^(.*)/[^/]*\z", 1)
    siblings = Window.partitionBy("parent").orderBy(F.desc("events"), "seg")
    return tree.withColumn("parent", parent).withColumn("place", F.row_number().over(siblings).cast("bigint"))


def payload_shapes(log: DataFrame) -> DataFrame:
    """Events per collection, type and the names in their payloads: (owner, type, names, n, first).

    ``names`` tells which of them hold arrays; it is NULL where the payload is no JSON object.
    """
    members = F.try_variant_get(whole_json(F.col("data")), "$", "map<string,variant>")
    read = log.select(first_segment(F.col("subject")).alias("owner"), "type", "id", members.alias("members")).where("owner <> ''")
    # The test for NULL makes a second use of the parsed payload, so it stays a projection of its own:
    # inside the function over its entries the text would be parsed once for every use.
    names = F.when(F.col("members").isNotNull(), F.transform(F.map_entries("members"), lambda e: F.struct(
        e["key"].alias("field"), F.schema_of_variant(e["value"]).startswith("ARRAY").alias("array"))))
    return read.select("owner", "type", "id", names.alias("names")).groupBy("owner", "type", "names").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


class References:
    """Relationships inferred from foreign-key-like payload fields.

    Only the *names* of such fields (and whether they hold arrays) matter, so events
    are first grouped by collection, type and the names in their payloads, then by field
    set; everything after works on those few groups.
    """

    def __init__(self, log: DataFrame) -> None:
        fields = F.array_sort(
            F.transform(
                F.filter("names", lambda e: reference_stem(e["field"]) != ""),
                lambda e: F.struct(
                    e["field"].alias("field"),
                    reference_stem(e["field"]).alias("stem"),
                    (reference_suffix(e["field"]).isin("ids", "refs") | e["array"]).alias("many"),
                ),
            )
        )
        # One row per field set; kept, since nodes, targets and edges all start here.
        self._groups = cut_lineage(
            payload_shapes(log).select("owner", "type", fields.alias("fields"), "n", "first")
            .groupBy("owner", "type", "fields")
            .agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        )
        self._collections = self._groups.groupBy(F.col("owner").alias("name")).agg(F.sum("n").alias("events"))
        self._links = self._resolved()

    def _resolved(self) -> DataFrame:
        """One row per group, field and target; one field per target within a group."""
        spread = self._groups.select("owner", "type", "fields", "n", "first", F.explode("fields").alias("f")).select(
            "owner", "type", "fields", "n", "first", "f.*"
        )
        stems = spread.select("stem").distinct()
        names = F.array(
            F.struct(F.lit(0).alias("prio"), F.col("stem").alias("name")),
            F.struct(F.lit(1).alias("prio"), F.concat("stem", F.lit("s")).alias("name")),
            F.when(F.col("stem").endswith("s"),
                   F.struct(F.lit(2).alias("prio"), F.regexp_replace("stem", r"s\z", "").alias("name"))),
        )
        tried = stems.select("stem", F.explode(names).alias("c")).where("c IS NOT NULL").select("stem", "c.*")
        known = tried.join(self._collections.select("name"), "name", "left_semi").groupBy("stem").agg(
            F.min_by("name", "prio").alias("target")
        )
        linked = spread.join(known, "stem", "left").select(
            "owner", "type", "fields", "n", "first", "field", "many",
            F.coalesce("target", "stem").alias("target"), F.col("target").isNotNull().alias("known"),
        ).where("target <> owner")
        return linked.groupBy("owner", "type", "fields", "n", "first", "target", "known").agg(
            F.min(F.struct("field", "many")).alias("f")
        )

    def edges(self) -> DataFrame:
        """Edges (from, to, kind, via, count)."""
        per_group = self._links.groupBy("owner", "type", "fields", "n", "first").agg(
            F.array_sort(F.collect_list(F.struct("target", F.col("f.field").alias("field"), F.col("f.many").alias("many"))))
            .alias("t")
        )
        pair, one = F.size("t") >= 2, F.get("t", F.lit(0))
        edge = per_group.select(
            F.when(pair, one["target"]).otherwise(F.col("owner")).alias("from"),
            F.when(pair, F.get("t", F.lit(1))["target"]).otherwise(one["target"]).alias("to"),
            F.when(pair, "n:m").when(one["many"], "1:n").otherwise("n:1").alias("kind"),
            F.when(pair, F.col("type")).otherwise(one["field"]).alias("via"),
            "n", "first",
        )
        return edge.groupBy("from", "to", "kind").agg(
            F.min_by("via", "first").alias("via"), F.sum("n").alias("count")
        ).select("from", "to", "kind", "via", "count").orderBy(F.desc("count"), "from", "to")

    def nodes(self) -> DataFrame:
        """Collections and the targets fields point at (name, known, events)."""
        targets = self._links.select(F.col("target").alias("name")).distinct()
        known = self._collections.withColumn("known", F.lit(True))
        return known.join(targets, "name", "full").select(
            "name", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("events", F.lit(0)).alias("events")
        ).orderBy(F.desc("events"), "name")


def resolve_collection(stems: DataFrame, collections: DataFrame) -> DataFrame:
    """(stem, target, known): a stem as it is, in plural or in singular if such exists."""
    name = F.lower("stem")
    tried = stems.select(
        "stem",
        F.posexplode(F.array_compact(F.array(
            name, F.concat(name, F.lit("s")), F.when(name.endswith("s"), F.regexp_replace(name, r"s\z", ""))
        ))).alias("prio", "name"),
    )
    hit = tried.join(collections.select("name").distinct(), "name", "left_semi").groupBy("stem").agg(
        F.min_by("name", "prio").alias("target")
    )
    return stems.join(hit, "stem", "left").select(
        "stem", F.coalesce("target", F.lower("stem")).alias("target"), F.col("target").isNotNull().alias("known")
    )


def _unquote(token: Column) -> Column:
    """Text of a JSON string token; only tokens with escapes need parsing."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    parsed = F.try_variant_get(F.try_parse_json(token), "$", "string")
    return F.when(F.contains(token, F.lit("\\")), parsed).otherwise(plain)


def payload_references(log: DataFrame) -> DataFrame:
    """String values under reference-like keys at any depth: (id, subject, field, ref_subject).

    In valid JSON a string before a colon is a key, so a left-to-right scan over the
    string tokens finds every key with a string value, however deep.
    """
    likely = F.lower("data").rlike(r'(?:id|ids|ref|refs)\s*"\s*:|\\')
    # Evaluated in a projection: a generator would parse each text once for every use of the result.
    text = F.when(likely & whole_json(F.col("data")).isNotNull(), F.col("data"))
    texts = log.select("id", "subject", text.alias("_text"))
    # Step by step inside the array, so that no step is evaluated again by the ones after it.
    steps = F.filter(F.regexp_extract_all("_text", F.lit(_TOKEN), F.lit(0)), lambda t: F.contains(t, F.lit(":")))
    steps = F.transform(steps, lambda t: F.struct(
        F.regexp_extract(t, rf"(?s)^({_STRING})\s*:", 1).alias("key"), t.alias("token")))
    steps = F.transform(F.filter(steps, lambda p: p["key"] != ""), lambda p: F.struct(
        _unquote(p["key"]).alias("field"), p["token"].alias("token")))
    steps = F.transform(steps, lambda p: F.struct(
        p["field"].alias("field"), reference_stem(F.regexp_replace(p["field"], r"^\s+|\s+\z", "")).alias("stem"), p["token"].alias("token")))
    steps = F.transform(F.filter(steps, lambda p: p["stem"] != ""), lambda p: F.struct(
        p["field"].alias("field"), plural_of(p["stem"]).alias("collection"),
        F.regexp_extract(p["token"], rf"(?s):\s*({_STRING})\z", 1).alias("value")))
    steps = F.transform(steps, lambda p: F.struct(
        p["field"].alias("field"), p["collection"].alias("collection"), _unquote(p["value"]).alias("value")))
    # Outer explode: an inner one would scan each text a second time to test for rows.
    found = texts.select("id", "subject", F.explode_outer(F.filter(steps, lambda p: p["value"] != "")).alias("p")).where("p IS NOT NULL")
    return found.select("id", "subject", "p.field", F.concat(F.lit("/"), "p.collection", F.lit("/"), "p.value").alias("ref_subject"))


def referenced_events(log: DataFrame, chosen: DataFrame, subtree: bool = False) -> DataFrame:
    """Events of the subjects that the payloads of ``chosen`` events refer to.

    The referenced subjects are a key set that the log is reduced by; nothing is joined
    event by event.  ``subtree`` takes what lies under those subjects too: distinct
    subjects are looked up by each of their own leading paths.
    """
    keys = payload_references(chosen).select(F.col("ref_subject").alias("subject")).distinct()
    if subtree:
        parts = F.split("subject", "/")
        paths = F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        under = log.select("subject").distinct().select("subject", F.explode(paths).alias("_path"))
        keys = under.join(keys.withColumnRenamed("subject", "_path"), "_path", "left_semi").select("subject").distinct()
    return log.join(keys, "subject", "left_semi").select(*log.columns)


def resolve_references(log: DataFrame) -> DataFrame:
    """How often each subject is referred to, and how many events it has itself.

    Both sides are counted per subject before they meet, so a subject with many
    references and many events does not multiply.
    """
    named = payload_references(log).groupBy("ref_subject").agg(F.count(F.lit(1)).alias("references"))
    own = log.groupBy(F.col("subject").alias("ref_subject")).agg(F.count(F.lit(1)).alias("events"))
    return named.join(own, "ref_subject", "left").select(
        "ref_subject", "references", F.coalesce("events", F.lit(0)).alias("events")
    )
