"""Secrets with corpus-wide ownership: who holds a candidate decides whether it is an example.

Every candidate is hashed and counted over distinct owners and their repositories. A value
that COPIED_OWNERS or more owners hold is a copied example, any other is taken for live. The
base kinds stay spans in either case, with the flag ``copied``; the kinds of ``METHOD`` need a
live-looking value as well and are spans only if live.

Spans are found by splitting a text at its matches, so places are sums of lengths in code
points, end exclusive. A null text is empty; a null owner or repository counts as one more
owner or repository. Spans depend on the text and on the corpus counts alone: repeated rows
and rows with null ids get equal spans. An empty table gives an empty result. Input columns
may have any names; only those asked for are read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .words import or_empty, pin

# Fixed patterns of the base kinds and the smallest length of the group that decides.
BASE = {
    "assign": (
        "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8
    ),
    "access": ("AKIA[A-Z0-9]+", 0, 16),
    "hex": ("[0-9a-f]+", 0, 32),
}
# Patterns that every text with a span of the kind matches, the cheapest first. Runs are
# tried from their start only.
HINTS = {
    "assign": ("[:=]", BASE["assign"][0]),
    "access": ("AKIA", "AKIA[A-Z0-9]{12}"),
    "hex": ("(?<![0-9a-f])[0-9a-f]{32}",),
    "issued": ("[_-]|AIza|eyJ", "(?=[gxsrAne])(?:gh[pos]_|github_pat_|glpat-|xox[abprs]-|[sr]k_live_|AIza|npm_|eyJ)"),
    "mixed": ("(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32}",),
}
# Public formats of issued credentials, and long runs that mix digits with both cases.
METHOD = {
    "issued": (
        "(?:ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|npm_|eyJ)[A-Za-z0-9_.=-]{16,}", 0, 20
    ),
    "mixed": ("[A-Za-z0-9+/_-]{32,}={0,2}", 0, 32),
}
KINDS = BASE | METHOD
BASE_KINDS = tuple(BASE)
COPIED_OWNERS = 3
MIN_DISTINCT = 12
BLOCK = 256
REDACTED = "[REDACTED]"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _running(lengths: Column) -> Column:
    """Sum of all earlier elements, for each element; blocks keep it far from quadratic."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(lengths) / BLOCK).cast("int")),
        lambda b: _sum(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))),
    )
    return F.transform(lengths, lambda _, i: (
        _sum(F.slice(blocks, F.lit(1), (i / BLOCK).cast("int")))
        + _sum(F.slice(lengths, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))
    ))


def _may_hold(text: Column, kind: str) -> Column:
    hit = F.lit(True)
    for hint in HINTS[kind]:
        hit = hit & text.rlike(hint)
    return hit


def _mixed(value: Column) -> Column:
    """Digits and letters of both cases, enough of them different."""
    return (
        value.rlike("[0-9]") & value.rlike("[a-z]") & value.rlike("[A-Z]")
        & (F.size(F.array_distinct(F.split(value, ""))) >= MIN_DISTINCT)
    )


def _found(df: DataFrame, kind: str) -> DataFrame:
    """Adds the spans of one kind; texts that cannot hold any pay one search only."""
    pattern, group, least = KINDS[kind]
    text = F.col("_text")
    hit = _may_hold(text, kind)
    none = F.array().cast("array<string>")
    df = df.withColumns({
        "_all": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none),
        "_val": F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none),
        "_gap": F.when(hit, F.split(text, pattern, -1)).otherwise(none),
    })
    df = df.withColumn("_step", F.transform("_all", lambda m, i: F.length(F.get("_gap", i)) + F.length(m)))
    df = df.withColumn("_before", _running(F.col("_step")))
    spans = F.transform("_all", lambda m, i: F.struct(
        (F.get("_before", i) + F.length(F.get("_gap", i))).alias("start"),
        F.lit(list(KINDS).index(kind)).alias("rank"),
        (F.get("_before", i) + F.get("_step", i)).alias("end"),
        F.lit(kind).alias("kind"),
        F.get("_val", i).alias("value"),
    ))
    spans = F.filter(spans, lambda s: F.length(s["value"]) >= least)
    if kind in METHOD:
        spans = F.filter(spans, lambda s: _mixed(s["value"]))
    hashed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
        F.sha2(s["value"], 256).alias("hash"),
    ))
    return df.withColumn(f"_{kind}", hashed).drop("_all", "_val", "_gap", "_step", "_before")


def candidates(docs: DataFrame, owner: str, repository: str, keep: list[str]) -> DataFrame:
    """``keep`` as struct _row, owner, repository, text key and candidate spans, row by row."""
    row = [F.struct(*[F.col(c) for c in keep]).alias("_row")] if keep else []
    out = docs.select(
        *row, F.col(owner).alias("_owner"),
        F.col(repository).alias("_repository"), or_empty(F.col("text")).alias("_text"),
    )
    for kind in KINDS:
        out = _found(out, kind)
    out = out.withColumn("_cands", F.concat(*[F.col(f"_{k}") for k in KINDS]))
    key = F.when(F.size("_cands") > 0, F.sha2("_text", 256)).alias("_key")
    return out.select(*["_row"] * bool(keep), "_owner", "_repository", key, "_cands")


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_owners, n_repositories over all candidates; distinct owners are cut before the count."""
    flat = found.select("_owner", "_repository", F.explode("_cands.hash").alias("hash"))
    whose = [F.struct("_owner").alias("owner"), F.struct("_repository").alias("repository")]
    each = flat.select("hash", *whose).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories")
    )


def verdicts(found: DataFrame) -> DataFrame:
    """_key, spans: for each distinct text its spans in order, each with ``copied``."""
    texts = found.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.first("_cands").alias("_cands"))
    flat = texts.select("_key", F.explode("_cands").alias("s"))
    judged = flat.join(ownership(found), flat["s.hash"] == F.col("hash")).withColumn(
        "copied", F.col("n_owners") >= COPIED_OWNERS
    ).where(F.col("s.kind").isin(*BASE_KINDS) | ~F.col("copied"))
    span = F.struct("s.start", "s.rank", "s.end", "s.kind", "copied", "n_owners", "n_repositories", "s.hash")
    return judged.groupBy("_key").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, owner: str, repository: str, keep: list[str]) -> DataFrame:
    """``keep`` and spans: array of start, end, kind, copied and the counts, by start, then kind."""
    found = settle(candidates(docs, owner, repository, keep), "secret-candidates")
    judged = verdicts(found)
    none = F.array().cast(judged.schema["spans"].dataType)
    plain = found.where(F.col("_key").isNull()).select("_row.*", none.alias("spans"))
    held = found.where(F.col("_key").isNotNull()).join(judged, "_key", "left")
    return plain.unionByName(held.select("_row.*", F.coalesce("spans", none).alias("spans")))


def _places(judged: DataFrame) -> DataFrame:
    """_key, _places: start and end of what the spans of each text cover, overlapping ones merged, in order."""
    flat = judged.select("_key", F.explode("spans").alias("s")).select("_key", "s.start", "s.end")
    earlier = Window.partitionBy("_key").orderBy("start", "end")
    reached = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    opens = flat.withColumn("_opens", F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int"))
    numbered = opens.withColumn(
        "_at", F.sum("_opens").over(earlier.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = numbered.groupBy("_key", "_at").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return merged.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_places"))


def _without(df: DataFrame) -> DataFrame:
    """_row, _places and ``_new``, the text with REDACTED at the places; blocks keep it far from quadratic."""
    text = or_empty(F.col("_row.text"))
    parts = pin(df, "_m", F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("blocks"),
        F.length(text).alias("length"),
    ), "_row", "_places")

    def cut(start: Column, end: Column) -> Column:
        first, last = (start / BLOCK).cast("int"), (end / BLOCK).cast("int")
        head, tail = F.get("_m.blocks", first), F.coalesce(F.get("_m.blocks", last), F.lit(""))
        between = F.slice("_m.blocks", first + 2, F.greatest(last - first - 1, F.lit(0)))
        return F.when(start >= end, F.lit("")).when(
            first == last, F.substring(head, start % BLOCK + 1, end - start)
        ).otherwise(F.concat(
            F.substring(head, start % BLOCK + 1, F.lit(BLOCK)), F.array_join(between, ""),
            F.substring(tail, F.lit(1), end % BLOCK),
        ))

    def ended(i: Column) -> Column:
        return F.coalesce(F.get("_places", i)["end"], F.lit(0))

    kept = F.transform("_places", lambda s, i: F.concat(cut(ended(i - 1), s["start"]), F.lit(REDACTED)))
    rest = cut(ended(F.size("_places") - 1), F.col("_m.length"))
    return parts.select("_row", "_places", F.concat(F.array_join(kept, ""), rest).alias("_new"))


def redact(docs: DataFrame, owner: str = "source", repository: str = "lang") -> DataFrame:
    """``docs`` with every span replaced by REDACTED at its place; other texts as they were.

    Overlapping spans are replaced as one. Texts without a candidate are not moved.
    """
    text = or_empty(F.col("text"))
    suspect = F.lit(False)
    for kind in KINDS:
        suspect = suspect | _may_hold(text, kind)
    found = settle(candidates(docs.where(suspect), owner, repository, []), "secret-candidates")
    judged = _places(verdicts(found))
    rows = docs.where(suspect).select(F.struct(*docs.columns).alias("_row"), F.sha2(text, 256).alias("_key"))
    out = _without(rows.join(judged, "_key", "left").select("_row", "_places"))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_new").cast(docs.schema["n_chars"].dataType)
    changed = F.col("_places").isNotNull()
    columns = [
        (F.when(changed, new[c]).otherwise(F.col("_row")[c]) if c in new else F.col("_row")[c]).alias(c)
        for c in docs.columns
    ]
    return docs.where(~suspect).unionByName(out.select(*columns))
