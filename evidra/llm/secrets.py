"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Candidates of four kinds are found in every whole text: assignments to words such as password,
access keys, long hexadecimal strings, and opaque tokens (long, with capitals, small letters and
digits) that overlap none of those. A candidate's value is hashed, and for each hash the distinct
owners and repositories that hold it are counted over the whole corpus: pre-aggregated to one row
per hash, owner and repository, then per hash and owner, then per hash. A value that over
MAX_OWNERS owners or over MAX_REPOS repositories hold is a widely copied example. A value that few hold and that looks live (many
different characters, no word such as "example") is an owner's credential.

The first three kinds are always reported. Opaque tokens are added where they are credentials.

Scans are written to the shared folder without texts, with a number per row, so that rows with the
same id stay apart. Only candidates are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm._common import bounded, discard, fresh, materialize

#: Kind, what to gate texts by, pattern, group of the value, its least length. Where
#: runs that are too short can't hide a longer one, the pattern has the least length itself.
BASE_KINDS = (
    ("assign", r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14}", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16}", r"[0-9a-f]{16,}", 0, 16),
)
OPAQUE = ("opaque", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}", 0, 24)
KINDS = (*BASE_KINDS, OPAQUE)
#: Both decide: a few owners with many repositories each hold a copied example too.
MAX_OWNERS, MAX_REPOS = 3, 6
LEAST_CHARACTERS = 8
PLACEHOLDERS = r"(?i)example|sample|placeholder|changeme|dummy|xxxx|your[_-]"
#: What takes a credential's place in a cleaned text.
REDACTED = "<secret>"
FOUND = "array<struct<start:bigint,ord:int,end:bigint,kind:string,hash:string,live:boolean>>"


def _spans(text: Column, ord: int) -> Column:
    """Candidates of one kind, leftmost and not overlapping, by code points."""
    kind, gate, pattern, group, least = KINDS[ord]
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(state: Column, pair: Column) -> Column:
        start = state.at + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        value = F.regexp_extract(pair["match"], pattern, group) if group else pair["match"]
        span = F.struct(start.alias("start"), F.lit(ord).alias("ord"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.concat(state.spans, F.array(span)).alias("spans"))

    none = F.array().cast("array<struct<start:bigint,ord:int,end:bigint,value:string>>")
    pairs = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match"))), lambda p: p["match"].isNotNull())
    placed = F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), place).spans
    # Before the slower gate: assignments need one of these characters.
    cheap = text.contains(":") | text.contains("=") if kind == "assign" else F.lit(True)
    return F.when(cheap & text.rlike(gate), F.filter(placed, lambda s: F.length(s.value) >= least)).otherwise(none)


def candidates(text: Column) -> Column:
    """All candidates of a text in order of start and kind; live says that a value looks like a credential."""
    body = F.coalesce(text, F.lit(""))
    base = F.concat(*[_spans(body, k) for k in range(len(BASE_KINDS))])
    mixed = lambda s: s.value.rlike("[A-Z]") & s.value.rlike("[a-z]") & s.value.rlike("[0-9]")
    opaque = F.filter(_spans(body, len(BASE_KINDS)), mixed)
    # Opaque tokens that overlap another candidate are part of it.
    opaque = F.filter(opaque, lambda o: ~F.exists(base, lambda b: (b.start < o.end) & (o.start < b.end)))
    names = F.array(*[F.lit(k[0]) for k in KINDS])

    def judged(s: Column) -> Column:
        live = (F.size(F.array_distinct(F.split(s.value, ""))) >= LEAST_CHARACTERS) & ~s.value.rlike(PLACEHOLDERS)
        return F.struct(s.start, s.ord, s.end, F.get(names, s.ord).alias("kind"), F.sha2(s.value, 256).alias("hash"), live.alias("live"))

    return F.array_sort(F.transform(F.concat(base, opaque), judged)).cast(FOUND)


def ownership(values: DataFrame) -> DataFrame:
    """hash, n_owners, n_repos. values: hash, owner, repo; a null owner or repo is one of its own."""
    by_repo = values.select("hash", "owner", "repo").distinct()
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"))


def _decided(scanned: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """row, spans: of each row with candidates, each with n_owners, n_repos and verdict. scanned: row, owner, repo, found."""
    each = scanned.select("row", "owner", "repo", F.inline("found"))
    counted = each.drop("owner", "repo").join(ownership(each), "hash")
    verdict = F.when((F.col("n_owners") > max_owners) | (F.col("n_repos") > max_repos), "example").when(F.col("live"), "credential").otherwise("unlikely")
    span = F.struct("start", "ord", "end", "kind", verdict.alias("verdict"), "n_owners", "n_repos")
    spans = F.array_sort(F.collect_list(span))
    kept = F.filter("spans", lambda s: (s.kind != "opaque") | (s.verdict == "credential"))
    return counted.groupBy("row").agg(spans.alias("spans")).withColumn("spans", kept)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def scan_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, doc: str = "doc_id", text: str = "text", owner: str | Column = "source", repo: str | Column = "source") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_credentials, n_examples, secrets.

    spans has kind:start:end of all spans, comma-joined; secrets the same as an array with verdict,
    n_owners and n_repos. Null texts are empty and have no spans. Repeated documents keep a row
    each and count as one owner. Null owners and repositories are one of their own. Spans with the
    same start come in the order of KINDS. An empty table gives no rows. Other columns are not read.
    """
    owner, repo = (F.col(c) if isinstance(c, str) else c for c in (owner, repo))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc).alias("id"), owner.alias("owner"), repo.alias("repo"), candidates(F.col(text)).alias("found"))
    scanned = materialize(rows)
    some, none = scanned.where(F.size("found") > 0), scanned.where(F.size("found") == 0)
    decided = some.select("row", "id").join(_decided(some, max_owners, max_repos), "row").select("id", "spans")
    all_rows = decided.unionByName(none.select("id", F.lit(None).cast(decided.schema["spans"].dataType).alias("spans")))
    spans = F.coalesce("spans", F.array().cast(decided.schema["spans"].dataType))
    base = F.filter("spans", lambda s: s.kind != "opaque")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda kind: lambda s: s.kind == kind
    return all_rows.withColumn("spans", spans).select(
        F.col("id").alias(doc),
        *[count(of_kind(k[0])).alias(f"n_{k[0]}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        count(lambda s: s.verdict == "credential").alias("n_credentials"), count(lambda s: s.verdict == "example").alias("n_examples"),
        F.col("spans").alias("secrets"),
    )


def _digest(text: Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit("text"), text).alias("y"))


def redact_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, text: str = "text", owner: str | Column = "source", repo: str | Column = "source") -> DataFrame:
    """docs, all columns and rows, with REDACTED in place of each credential in the texts.

    Widely copied examples and unlikely values stay, and so do texts without candidates, null or
    empty ones. Of credentials that overlap, the later is cut where the earlier ends. Equal texts
    have the same spans, so only a digest of the text and its credentials are written and joined;
    the texts stay where they are read.
    """
    owner, repo = (F.col(c) if isinstance(c, str) else c for c in (owner, repo))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), _digest(F.col(text)).alias("digest"), owner.alias("owner"), repo.alias("repo"), candidates(F.col(text)).alias("found"))
    scanned = materialize(rows.where(F.size("found") > 0))
    live = F.filter("spans", lambda s: s.verdict == "credential")
    live = F.transform(live, lambda s: F.struct(s.start.cast("int").alias("start"), s.end.cast("int").alias("end")))
    decided = _decided(scanned, max_owners, max_repos).select("row", live.alias("live")).where(F.size("live") > 0)
    named = scanned.select("row", "digest").join(decided, "row").groupBy("digest").agg(F.first("live").alias("live"))
    cuts = materialize(named)
    discard(scanned)
    spans = cuts.agg(F.coalesce(F.sum(F.size("live")), F.lit(0))).first()[0]
    at, digest = fresh(docs, "credentials_of_text", "digest_of_text")
    whole = F.col(text)

    def cut(state: Column, s: Column) -> Column:
        start = F.greatest(s.start, state.at)
        out = F.concat(state.out, F.substring(whole, state.at + 1, F.greatest(F.lit(0), start - state.at)), F.lit(REDACTED))
        return F.when(s.end <= state.at, state).otherwise(F.struct(F.greatest(s.end, state.at).cast("int").alias("at"), out.alias("out")))

    state = F.aggregate(at, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut)
    cleaned = F.when(F.col(at).isNull(), whole).otherwise(F.concat(state.out, F.substring(whole, state.at + 1, F.length(whole))))
    joined = docs.join(bounded(cuts.select(F.col("digest").alias(digest), F.col("live").alias(at)), spans), _digest(whole) == F.col(digest), "left")
    return joined.select(*[(cleaned if c == text else F.col(f"`{c}`")).alias(c) for c in docs.columns])
