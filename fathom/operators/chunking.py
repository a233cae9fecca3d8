"""Pages to parent and child chunks, and their contexts. Ids depend on the content's place only, so ingesting again overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.sources.workspace import spread

#: Letters of a parent that its children's contexts begin with.
HEAD = 200


def parents(pages: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """``pages``: doc_id, filename, page, text. Windows never span pages."""
    cut = spread(pages.select("doc_id", "filename", "page", "text")).select("doc_id", "filename", "page", F.posexplode(T.windows(T.words("text"), size, overlap)).alias("p_idx", "content"))
    suffix = F.substring(F.md5(F.concat_ws("|", "doc_id", "page", "p_idx")), 1, 8)
    return cut.select(
        F.concat_ws("_", "doc_id", F.lit("p"), "p_idx", suffix).alias("parent_id"), "doc_id", "filename", "content", F.col("page").alias("page_start"), F.col("page").alias("page_end")
    )


def children(parents_: DataFrame, size: int = 200, overlap: int = 30, head: bool = False) -> DataFrame:
    """With ``head``, the beginning of the parent goes along (see ``contextualise``)."""
    own = [F.substring("content", 1, HEAD).alias("head")] if head else []
    cut = parents_.select("parent_id", "doc_id", "filename", "page_start", *own, F.posexplode(T.windows(T.words("content"), size, overlap)).alias("c_idx", "content"))
    return cut.select(F.concat_ws("_", "parent_id", F.lit("c"), "c_idx").alias("chunk_id"), "parent_id", "doc_id", "filename", "content", F.col("page_start").alias("page_number"), *(["head"] if head else []))


def contextualise(children_: DataFrame, parents_: DataFrame | None = None) -> DataFrame:
    """Adds ``contextualized_content``: file, page and the beginning of the parent (without ``parents_`` the column ``head``); orphans keep their content."""
    if parents_ is not None:
        children_ = children_.join(parents_.select("parent_id", F.substring("content", 1, HEAD).alias("head")), "parent_id", "left")
    made = F.concat(F.lit("Document: "), "filename", F.lit(" (Page "), F.col("page_number").cast("string"), F.lit(")\nSection: "), "head", F.lit("...\n\n"), "content")
    return children_.withColumn("contextualized_content", F.coalesce(made, "content")).drop("head")


def split_by_size(segments: DataFrame, least_tokens: float = 50.0, key: str = "text") -> DataFrame:
    """Segments of at most ``least_tokens`` stay as they are, longer ones become blocks that just reach it."""
    block = -int(-least_tokens // 1.3)
    # n words have 2 n - 1 letters at least: those of short texts need no count
    short = F.length(key) < 2 * int(least_tokens / 1.3) - 1
    pieces = F.when(short | (T.token_estimate(key) <= least_tokens), F.array(key)).otherwise(T.windows(T.words(key), block, 0))
    rest = [c for c in segments.columns if c != key]
    return segments.select(*rest, F.posexplode(pieces).alias("piece", key))


def legacy_context(chunks: DataFrame) -> DataFrame:
    """``page_info``, ``contextualized_content`` and ``text_to_embed`` where no model summarises the chunk."""
    out = chunks.withColumn("page_info", T.page_info("page_start", "page_end"))
    out = out.withColumn("contextualized_content", F.concat("content", F.lit("\n"), "page_info"))
    return out.withColumn("text_to_embed", F.concat("content", F.lit("\n\n"), "contextualized_content"))


def summarised_context(chunks: DataFrame, summary) -> DataFrame:
    """As ``legacy_context``, where a model's ``summary`` (a column) of the chunk is there."""
    out = chunks.withColumn("page_info", T.page_info("page_start", "page_end"))
    made = F.concat_ws("\n", F.concat(F.lit("Content Summary: "), summary), F.concat(F.lit("Page(s): "), F.col("page_info")))
    out = out.withColumn("contextualized_content", made)
    return out.withColumn("text_to_embed", F.concat("content", F.lit("\n\n"), "contextualized_content"))


def rerank_text(original: str = "original_content", context: str = "contextualized_content"):
    return F.concat(F.col(original), F.lit("\n\nContext: "), F.col(context))
