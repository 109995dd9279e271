"""Readers of chat exports: JSON texts to messages and fragments, in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.operators.chats import branch, role

CLAUDE = "array<struct<uuid:string,name:string,created_at:string,chat_messages:array<struct<uuid:string,sender:string,created_at:string,text:string>>>>"
CHATGPT = "array<struct<conversation_id:string,title:string,current_node:string,mapping:map<string,struct<id:string,parent:string,message:struct<author:struct<role:string>,create_time:double,content:struct<content_type:string,parts:array<string>>>>>>>"


def claude(texts: DataFrame, column: str = "text") -> DataFrame:
    """conv_id, turn, role, text, ts of each message of each export."""
    c = texts.select(F.explode(F.from_json(column, CLAUDE)).alias("c"))
    m = c.select(F.col("c.uuid").alias("conv_id"), F.posexplode("c.chat_messages").alias("turn", "m"))
    return m.select("conv_id", F.col("turn").cast("long").alias("turn"), role(F.col("m.sender")).alias("role"), F.col("m.text").alias("text"), F.to_timestamp("m.created_at").alias("ts"))


def chatgpt(texts: DataFrame, column: str = "text") -> DataFrame:
    """conv_id, node, kind, role, text, ts: the branch that ends at the current node, and the messages off it."""
    c = texts.select(F.explode(F.from_json(column, CHATGPT)).alias("c"))
    n = c.select(F.col("c.conversation_id").alias("conv_id"), F.col("c.current_node").alias("head"), F.explode("c.mapping").alias("node", "v"))
    nodes = n.select("conv_id", "head", "node", F.col("v.parent").alias("parent"), role(F.col("v.message.author.role")).alias("role"), F.array_join("v.message.content.parts", "\n").alias("text"), F.timestamp_seconds("v.message.create_time").alias("ts"))
    kinds = branch(nodes.select("conv_id", "node", "parent"), nodes.select("conv_id", F.col("head").alias("node")).distinct())
    return kinds.join(nodes.drop("head", "parent"), ["conv_id", "node"]).filter("text is not null")


def generic(texts: DataFrame, threads: str, conv_id: str, messages: str, speaker: str, body: str, column: str = "text") -> DataFrame:
    """conv_id, turn, role, text by a mapping of field names, for exports of any shape ``{threads: [{messages: [...]}]}``."""
    schema = f"struct<`{threads}`:array<struct<`{conv_id}`:string,`{messages}`:array<struct<`{speaker}`:string,`{body}`:string>>>>>"
    c = texts.select(F.explode(F.from_json(column, schema).getField(threads)).alias("c"))
    m = c.select(F.col("c").getField(conv_id).alias("conv_id"), F.posexplode(F.col("c").getField(messages)).alias("turn", "m"))
    return m.select("conv_id", F.col("turn").cast("long").alias("turn"), role(F.col("m").getField(speaker)).alias("role"), F.col("m").getField(body).alias("text"))
