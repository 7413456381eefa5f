"""Secret scan with corpus-wide ownership, on DataFrame functions alone.

Patterns give candidate spans in each text. Digests of the candidate values are
counted over distinct repositories and owners: a value that many owners or many
repositories hold is a copied example, one that a single owner holds in few
repositories looks live. Candidates of the generic kinds become spans only if they
look live.

Spark has no function for the places of all matches; they follow from the
lengths of the matches and of the pieces between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprints import let
from .scratch import Scratch, steps

#: kind, pattern, group of the value, least length of the value
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"(AKIA[A-Z0-9]{14,}+)", 1, 18),
    ("hex", r"([0-9a-f]{16,}+)", 1, 16),
)
GENERIC = (
    ("private_key", r"(-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,20}PRIVATE KEY-----)", 1, 64),
    ("web_token", r"(eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)", 1, 34),
    ("prefixed", r"((?:gh[pousr]_|xox[abprs]-|sk_live_|glpat-)[A-Za-z0-9_-]{16,}+)", 1, 20),
)
BLOCK, SALTS = 64, 16


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def spans_of(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, ord, end, kind, digest>> of the matches of one kind whose value is long enough."""
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,digest:string>>")

    def made(x: Column) -> Column:
        size, gap, value = x["size"], x["gap"], x["value"]
        steps = F.zip_with(gap, size, lambda g, s: g + F.coalesce(s, F.lit(0)))

        def placed(y: Column) -> Column:
            def one(i: Column) -> Column:
                whole = F.floor(i / BLOCK).cast("int")
                start = _sum(F.slice(y["sums"], 1, whole)) + _sum(F.slice(y["steps"], whole * BLOCK + 1, i - whole * BLOCK)) + F.get(gap, i)
                v = F.get(value, i)
                return F.struct(start.cast("int").alias("start"), F.lit(order).alias("ord"), (start + F.get(size, i)).cast("int").alias("end"), F.lit(kind).alias("kind"), F.when(F.char_length(v) >= least, F.substring(F.sha2(v, 256), 1, 32)).alias("digest"))

            return F.filter(F.transform(F.sequence(F.lit(0), F.size(size) - 1), one), lambda s: s["digest"].isNotNull())

        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(size) / BLOCK).cast("int")), lambda b: _sum(F.slice(steps, b * BLOCK + 1, BLOCK)))
        return let(F.struct(steps.alias("steps"), sums.alias("sums")), placed)

    length = lambda a: F.transform(a, lambda s: F.char_length(s))
    parts = F.struct(
        length(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("size"),
        length(F.split(text, pattern, -1)).alias("gap"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), let(parts, made)).otherwise(none)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@steps("secrets")
def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", most_owners: int = 1, most_repos: int = 10, scratch: Scratch) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, held_by, live_spans, n_copied), one row for each row of ``docs``.

    Places are code points, ends exclusive. A value looks live if at most
    ``most_owners`` distinct owners and at most ``most_repos`` distinct repositories
    hold it. ``spans`` holds the base spans and those generic ones with a live value;
    ``held_by`` has owners:repositories of the value of each of them, in their order;
    ``live_spans`` holds the spans of either sort with a live value, ``n_copied``
    counts the base spans with another.

    Null text counts as empty. A null owner or repository counts as one unknown
    owner or repository. Null and repeated ids are scanned row by row. An empty
    table gives an empty result. Only the named columns are read, so others may
    have any name.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    unknown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    found = docs.select(F.col(id_col).alias("doc_id"), unknown(repo_col).alias("repo"), unknown(owner_col).alias("owner"), text.alias("text"))
    kinds = [spans_of(F.col("text"), i, *spec) for i, spec in enumerate([*BASE, *GENERIC])]
    found = found.select("doc_id", "repo", "owner", F.array_sort(F.concat(*kinds)).alias("found")).withColumn("row", F.monotonically_increasing_id())
    found = scratch.write(found, "found")
    each = found.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("span"))
    # only values that several repositories hold have to be looked up: of all others one owner and one repository hold the value
    held = each.select(F.col("span.digest").alias("digest"), "repo", "owner").distinct()
    owners = held.groupBy("digest", "owner").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("owners"))
    repos = held.groupBy("digest", "repo").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("repos"))
    copied = owners.join(repos.hint("merge"), "digest").where("owners > 1 or repos > 1")
    # a popular value meets its counts in SALTS tasks
    salted = scratch.write(copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "copied")
    asked = each.select("row", F.col("span.digest").alias("digest")).distinct().withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
    told = asked.join(salted.hint("merge"), ["digest", "salt"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("digest", F.struct("owners", "repos")))).alias("told"))
    one = F.struct(F.lit(1).cast("long").alias("owners"), F.lit(1).cast("long").alias("repos"))

    def judged(s: Column) -> Column:
        by = F.coalesce(F.try_element_at("told", s["digest"]), one)
        live = (by["owners"] <= most_owners) & (by["repos"] <= most_repos)
        return F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"), s["kind"].alias("kind"), live.alias("live"), F.concat_ws(":", by["owners"].cast("string"), by["repos"].cast("string")).alias("by"))

    out = found.join(told.hint("merge"), "row", "left").withColumn("s", F.transform("found", judged))
    base = F.filter("s", lambda s: s["ord"] < len(BASE))
    shown = F.filter("s", lambda s: (s["ord"] < len(BASE)) | s["live"])
    of = lambda i: F.size(F.filter("s", lambda s: s["ord"] == i)).cast("long")
    out = out.select(
        "doc_id",
        *[of(i).alias(f"n_{spec[0]}") for i, spec in enumerate(BASE)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(shown).alias("spans"),
        F.array_join(F.transform(shown, lambda s: s["by"]), ",").alias("held_by"),
        _joined(F.filter("s", lambda s: s["live"])).alias("live_spans"),
        F.size(F.filter(base, lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )
    result = scratch.write(out, "result")
    scratch.close("result")
    return result
