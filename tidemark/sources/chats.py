"""Chat sources (S5, S6, S8-S10): a table of keys and JSON values, with a record per conversation and
one per message."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, BUBBLE = "composerData:", "bubbleId:"
HEAD_SCHEMA = "createdAt long, lastUpdatedAt long, fullConversationHeadersOnly array<struct<bubbleId:string,type:int>>"
BUBBLE_SCHEMA = "type int, text string, richText string, createdAt string, isAgentic boolean, codeBlocks array<struct<languageId:string,content:string,filename:string>>, relevantFiles array<string>, attachedFiles array<string>"
# Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java",
    "kt": "kotlin", "swift": "swift", "php": "php", "cs": "csharp", "cpp": "cpp", "c": "c", "h": "c", "sql": "sql", "sh": "bash", "html": "html", "css": "css",
    "scss": "scss", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "vue": "vue", "svelte": "svelte", "xml": "xml", "toml": "toml",
}


def rich_text(node: object) -> str:
    """S9. The text of a rich-text tree, a line end behind each paragraph."""
    if isinstance(node, list):
        return "".join(map(rich_text, node))
    if not isinstance(node, dict):
        return ""
    inner = node.get("text", "") + rich_text(node.get("children", [])) + rich_text(node.get("root", []))
    return inner + "\n" if node.get("type") == "paragraph" else inner


def conversations(kv: DataFrame) -> DataFrame:
    """S5. conv_id, created and updated times and number of messages, last updated first, unknown
    times last. kv: key, value."""
    heads = kv.where(F.col("key").startswith(HEAD)).select(F.substr("key", F.lit(len(HEAD) + 1)).alias("conv_id"), F.from_json("value", HEAD_SCHEMA).alias("h"))
    at = lambda c: F.timestamp_millis(F.col(f"h.{c}"))
    return heads.select("conv_id", at("createdAt").alias("created_at"), at("lastUpdatedAt").alias("updated_at"), F.coalesce(F.size("h.fullConversationHeadersOnly"), F.lit(0)).alias("n_messages")).orderBy(F.desc_nulls_last("updated_at"), "conv_id")


def conversation_count(kv: DataFrame) -> int:
    """S8."""
    return kv.where(F.col("key").startswith(HEAD)).count()


def messages(kv: DataFrame) -> DataFrame:
    """S6, S10. conv_id, turn, role, text, code blocks and files, in the order of the headers. Headers
    meet messages by a join on the key, not by look-ups."""

    @F.pandas_udf("string")
    def plain(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rich in batches:
            yield rich.map(lambda r: rich_text(json.loads(r)) if r else None)

    heads = kv.where(F.col("key").startswith(HEAD)).select(F.substr("key", F.lit(len(HEAD) + 1)).alias("conv_id"), F.posexplode(F.from_json("value", HEAD_SCHEMA)["fullConversationHeadersOnly"]).alias("turn", "m"))
    wanted = heads.select("conv_id", "turn", F.concat(F.lit(BUBBLE), "conv_id", F.lit(":"), F.col("m.bubbleId")).alias("key"))
    bodies = kv.where(F.col("key").startswith(BUBBLE)).select("key", F.from_json("value", BUBBLE_SCHEMA).alias("b"))
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    language = lambda b: F.coalesce(F.nullif(b["languageId"], F.lit("")), F.try_element_at(known, F.element_at(F.split(F.coalesce(b["filename"], F.lit("")), r"\."), -1)), F.lit("text"))
    blocks = F.transform(F.coalesce("b.codeBlocks", F.array().cast("array<struct<languageId:string,content:string,filename:string>>")), lambda b: F.struct(language(b).alias("language"), b["content"].alias("code"), b["filename"].alias("filename")))
    none = F.array().cast("array<string>")
    return wanted.join(bodies, "key").select(
        "conv_id", "turn", F.when(F.col("b.type") == 1, "user").when(F.col("b.type") == 2, "assistant").alias("role"),
        F.coalesce(F.nullif("b.text", F.lit("")), plain(F.col("b.richText")), F.lit("")).alias("text"), blocks.alias("code_blocks"),
        F.array_distinct(F.concat(F.coalesce("b.relevantFiles", none), F.coalesce("b.attachedFiles", none))).alias("files"),
    )
