"""Prompts, histories and citations as ordered string aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.functions import text as T


def ordered_join(order: str, text: str, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r.t), separator)


def context_blocks(hits: DataFrame) -> DataFrame:
    """``hits``: qid, rank, filename, page_start, content. Returns qid, context."""
    block = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] (Document: "), "filename", F.lit(", Page "), F.col("page_start").cast("string"), F.lit(")\n"), "content")
    return hits.withColumn("block", block).groupBy("qid").agg(ordered_join("rank", "block", "\n\n---\n\n").alias("context"))


# What the model is told, and the answer without sources.
RULES = (
    "You are a helpful research assistant. Answer the user's question accurately based ONLY on the provided context.\n"
    "For every key factual claim, cite the relevant source using [Source X] notation.\n"
    "If the context does not contain enough information to answer, state clearly what is missing.\n\n"
)
NO_SOURCES = "No relevant documents found in the database to answer this question."


def answer_prompt(context, query) -> Column:
    return F.concat(F.lit(RULES + "Context:\n"), T.col(context), F.lit("\n\nQuestion: "), T.col(query), F.lit("\n\nAnswer:"))


def legacy_context(hits: DataFrame) -> DataFrame:
    """qid, context (``[Source i]: content``) and the list of citations that is put under the answer."""
    label = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]: "), "content")
    cited = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce(F.col("doc_id").cast("string"), F.lit("Unknown")), F.lit(", "), T.page_citation("page_start", "page_end"))
    rows = hits.withColumn("label", label).withColumn("cited", cited).groupBy("qid")
    return rows.agg(ordered_join("rank", "label", "\n\n").alias("context"), F.concat(F.lit("\n\n**Sources:**\n"), ordered_join("rank", "cited", "\n")).alias("citations"))


# The prompts of the older answers and of the chat, before, between and after what is put in.
LEGACY_PROMPT = (
    "Based on the following context from documents, answer the question accurately and helpfully.\n\nContext:\n",
    "\n\nQuestion: ",
    "\n\nInstructions:\n1. Answer based primarily on the provided context\n2. Include relevant citations using [1], [2], etc. format\n"
    "3. If the context doesn't contain enough information, say so clearly\n4. Be precise and helpful\n\nAnswer:",
)
CHAT_PROMPT = (
    "You are an AI assistant helping users understand documents. Based on the provided context and conversation history, answer the user's question accurately and helpfully.\n\n"
    "Context from documents:\n",
    "\n\nPrevious conversation:\n",
    "\n\nCurrent question: ",
    "\n\nInstructions:\n1. Answer based solely on the provided context\n2. If the context doesn't contain enough information, say so clearly.\n"
    "3. Include relevant citations from the document like section, header, page number etc, when referencing specific sources.\n"
    "4. Be conversational and helpful while staying accurate\n5. If referring to previous parts of the conversation, make that clear\n"
    "6. Mention sources using (Source X) format, where X is the source number from the context.\n\nAnswer:",
)
CHAT_SOURCES = 25


def legacy_prompt(context, query) -> Column:
    start, question, end = map(F.lit, LEGACY_PROMPT)
    return F.concat(start, T.col(context), question, T.col(query), end)


def legacy_answer(reply, citations) -> Column:
    """The reply with its sources under it; a reply that failed is the text of its error (null here)."""
    return F.coalesce(F.concat(T.col(reply), F.coalesce(T.col(citations), F.lit(""))), F.lit("Error generating response: no reply"))


def chat_context(hits: DataFrame, most: int = CHAT_SOURCES) -> DataFrame:
    """``hits``: qid, rank, content, contextualized_content, page_start, page_end. Returns qid, context: blocks labelled by what heads the chunk."""
    head = {v: T.header("contextualized_content", v) for v in ("Chapter", "Section", "Heading", "Sub-Heading")}
    label = T.source_label("rank", head["Chapter"], head["Section"], head["Heading"], head["Sub-Heading"], T.page_citation("page_start", "page_end"))
    block = F.concat(label, F.lit(": "), F.coalesce("content", F.lit("")))
    return hits.where(F.col("rank") <= most).withColumn("block", block).groupBy("qid").agg(ordered_join("rank", "block", "\n\n").alias("context"))


def chat_prompt(context, history, query) -> Column:
    start, before, question, end = map(F.lit, CHAT_PROMPT)
    return F.concat(start, F.coalesce(T.col(context), F.lit("")), before, F.coalesce(T.col(history), F.lit("")), question, T.col(query), end)


def recent_history(messages: DataFrame, last: int = 6) -> DataFrame:
    """``messages``: conv_id, turn, role, text. The last messages of each conversation, oldest first."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = messages.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= last)
    line = F.concat(F.when(F.col("role") == "user", F.lit("Human")).otherwise(F.lit("Assistant")), F.lit(": "), F.coalesce("text", F.lit("")), F.lit("\n"))
    return kept.withColumn("line", line).groupBy("conv_id").agg(ordered_join("turn", "line", "").alias("history"))


def source_rows(hits: DataFrame) -> DataFrame:
    return hits.select("qid", F.col("rank").cast("int").alias("index"), "filename", "page_start", "page_end", "score", T.preview("content").alias("content_preview"))


def result_rows(hits: DataFrame, include_context: bool = True) -> DataFrame:
    content = F.col("content") if include_context else F.lit(None).cast("string")
    return hits.select("qid", F.col("rank").cast("int").alias("rank"), F.coalesce(F.col("doc_id").cast("string"), F.lit("Unknown")).alias("doc_id"), F.coalesce("score", F.lit(0.0)).alias("score"), "page_start", "page_end", content.alias("content"))
