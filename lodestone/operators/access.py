"""Who may see which chunk: one boolean expression for every backend, failing closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK_STRINGS = ("chunk_id", "document_id", "version_id", "text", "tenant_id", "visibility")
_SCOPE_STRINGS = ("user_id", "tenant_id", "acl_version")
_SCOPE_LISTS = ("library_ids", "folder_ids", "document_ids")


def _filled(col: Column) -> Column:
    return F.coalesce(F.length(col) > 0, F.lit(False))


def _ids(col: Column, strict: bool) -> Column:
    """The usable members of a list; null if the list is null or, if strict, has an unusable member."""
    good = F.filter(col, lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(good) == F.size(col), good) if strict else good


def well_formed_chunk(chunk: str = "chunk") -> Column:
    c = lambda n: F.col(f"{chunk}.{n}")
    ok = F.lit(True)
    for n in _CHUNK_STRINGS:
        ok = ok & _filled(c(n))
    return ok & c("page_start").isNotNull() & c("page_end").isNotNull() & c("library_scope_ids").isNotNull()


def well_formed_scope(scope: str = "scope", strict: bool = False) -> Column:
    c = lambda n: F.col(f"{scope}.{n}")
    ok = c("include_public").isNotNull()
    for n in _SCOPE_STRINGS:
        ok = ok & _filled(c(n))
    for n in _SCOPE_LISTS:
        ok = ok & c(n).isNotNull()
        if strict:
            ok = ok & ~F.exists(c(n), lambda x: x.isNull() | (x == ""))
    return ok


def selected(chunk: str = "chunk", scope: str = "scope") -> Column:
    """The chunk's document is listed or its libraries overlap the scope's; folders select nothing."""
    docs = F.array_contains(_ids(F.col(f"{scope}.document_ids"), False), F.col(f"{chunk}.document_id"))
    return F.coalesce(docs, F.lit(False)) | F.coalesce(F.arrays_overlap(_ids(F.col(f"{scope}.library_ids"), False), F.col(f"{chunk}.library_scope_ids")), F.lit(False))


def has_selectors(scope: str = "scope") -> Column:
    any_ = F.lit(False)
    for n in _SCOPE_LISTS:
        any_ = any_ | F.coalesce(F.size(_ids(F.col(f"{scope}.{n}"), False)) > 0, F.lit(False))
    return any_


def authorized(chunk: str = "chunk", scope: str = "scope", strict: bool = False) -> Column:
    """True only where an active, well-formed chunk is visible under a well-formed scope; never null.

    public: the scope includes public ones; tenant: same tenant; either selected or without selectors. private: same tenant and
    selected. Any other visibility is denied. strict denies scopes with an unusable list member, which otherwise is ignored.
    """
    c = lambda n: F.col(f"{chunk}.{n}")
    tenant = c("tenant_id") == F.col(f"{scope}.tenant_id")
    open_ = ~has_selectors(scope) | selected(chunk, scope)
    rule = F.when(c("visibility") == "public", F.col(f"{scope}.include_public") & open_).when(c("visibility") == "tenant", tenant & open_).when(c("visibility") == "private", tenant & selected(chunk, scope)).otherwise(False)
    return F.coalesce(c("is_active") & well_formed_chunk(chunk) & well_formed_scope(scope, strict) & rule, F.lit(False))


def granted(chunks: DataFrame, scopes: DataFrame, keep: list[str] = ("chunk_id", "document_id", "visibility"), strict: bool = False) -> DataFrame:
    """scope_id and the named columns of every chunk that the scope may see: the pairs that `authorized` accepts, by equality joins alone.

    A scope without selectors reaches its tenant's shared chunks and, if it includes them, the public ones: one join on the circle
    a chunk stands in. A scope with selectors reaches what its documents and libraries name: a join on each. Chunk identifiers are
    unique; a pair found twice counts once.
    """
    good = chunks.where(F.coalesce("is_active", F.lit(False))).select(F.struct(*chunks.columns).alias("chunk")).where(F.coalesce(well_formed_chunk(), F.lit(False)))
    asked = scopes.select("scope_id", F.struct(*[c for c in scopes.columns if c != "scope_id"]).alias("scope")).where(F.coalesce(well_formed_scope("scope", strict), F.lit(False)))
    c = good.select(*[F.col(f"chunk.{x}").alias(x) for x in dict.fromkeys([*keep, "chunk_id", "document_id", "tenant_id", "visibility", "library_scope_ids"])])
    tenant, public = F.col("scope.tenant_id"), F.col("scope.include_public")
    open_ = asked.where(~has_selectors()).select("scope_id", F.explode(F.array_compact(F.array(F.concat(F.lit("tenant:"), tenant), F.when(public, "public")))).alias("circle"))
    circle = F.when(F.col("visibility") == "public", "public").when(F.col("visibility") == "tenant", F.concat(F.lit("tenant:"), F.col("tenant_id")))
    by_circle = c.withColumn("circle", circle).join(open_, "circle").select("scope_id", *keep)
    some = asked.where(has_selectors()).select("scope_id", tenant.alias("s_tenant"), public.alias("s_public"), "scope")
    listed = some.select("scope_id", "s_tenant", "s_public", F.explode(F.array_distinct(_ids(F.col("scope.document_ids"), False))).alias("document_id"))
    shelved = some.select("scope_id", "s_tenant", "s_public", F.explode(F.array_distinct(_ids(F.col("scope.library_ids"), False))).alias("library_id"))
    seen = F.when(F.col("visibility") == "public", F.col("s_public")).when(F.col("visibility").isin("tenant", "private"), F.col("tenant_id") == F.col("s_tenant")).otherwise(False)
    named = c.join(listed, "document_id").where(seen).select("scope_id", *dict.fromkeys(["chunk_id", *keep]))
    held = c.withColumn("library_id", F.explode("library_scope_ids")).join(shelved, "library_id").where(seen).select("scope_id", *dict.fromkeys(["chunk_id", *keep]))
    both = named.union(held).dropDuplicates(["scope_id", "chunk_id"])
    return by_circle.union(both.select("scope_id", *keep))


def selected_counts(chunks: DataFrame, scopes: DataFrame) -> DataFrame:
    """scope_id, n_selected, selective: chunks that a scope's documents or libraries name, whatever else access asks; by equality joins."""
    s = scopes.select("scope_id", F.struct(*[c for c in scopes.columns if c != "scope_id"]).alias("scope"))
    listed = s.select("scope_id", F.explode(F.array_distinct(_ids(F.col("scope.document_ids"), False))).alias("document_id"))
    shelved = s.select("scope_id", F.explode(F.array_distinct(_ids(F.col("scope.library_ids"), False))).alias("library_id"))
    c = chunks.select("chunk_id", "document_id", "library_scope_ids")
    pairs = c.join(listed, "document_id").select("scope_id", "chunk_id").union(c.withColumn("library_id", F.explode("library_scope_ids")).join(shelved, "library_id").select("scope_id", "chunk_id"))
    counted = pairs.distinct().groupBy("scope_id").agg(F.count(F.lit(1)).alias("n"))
    return s.join(counted, "scope_id", "left").select("scope_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_selected"), has_selectors().alias("selective"))


def narrowed(scope: DataFrame, requested: str = "requested_document_ids") -> DataFrame:
    """Scopes whose request names documents list just these, without libraries and folders."""
    named = F.coalesce(F.size(requested) > 0, F.lit(False))
    none = F.array().cast("array<string>")
    return scope.withColumns({"document_ids": F.when(named, F.col(requested)).otherwise(F.col("document_ids")), "library_ids": F.when(named, none).otherwise(F.col("library_ids")), "folder_ids": F.when(named, none).otherwise(F.col("folder_ids"))})


def forbidden_requests(requested: DataFrame, granted: DataFrame, keys: list[str], document: str = "document_id") -> DataFrame:
    """Requests (keys) that name a document which isn't granted to them, with the number of such documents."""
    return requested.join(granted.select(*keys, document).distinct(), [*keys, document], "left_anti").groupBy(*keys).agg(F.count_distinct(document).alias("n_forbidden"))


def visible_versions(versions: DataFrame, owner: str | None = None, document_ids: DataFrame | None = None) -> DataFrame:
    """Active READY versions, of one owner and of the listed documents where given."""
    out = versions.where((F.col("lifecycle_status") == "READY") & F.coalesce(F.col("is_active"), F.lit(False)))
    if owner is not None:
        out = out.where(F.col("owner_id") == owner)
    return out if document_ids is None else out.join(document_ids, "document_id", "left_semi")
