"""Families that repeat an idiom, not a text: rules over the members' words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LITERAL = r"^[\"'(]*[-+]?[0-9][0-9.,_]*[\"')%;,]*$"


def is_literal(word: Column) -> Column:
    return word.rlike(LITERAL)


def shape(words: Column) -> Column:
    """Words with literals masked."""
    return F.array_join(F.transform(words, lambda w: F.when(is_literal(w), F.lit("#")).otherwise(w)), " ")


def literal_variation(members: DataFrame) -> DataFrame:
    """(component, file_id, words) -> components whose members differ in literals alone: one shape, many texts."""
    told = members.select("component", shape(F.col("words")).alias("shape"), F.array_join("words", " ").alias("text"))
    return told.groupBy("component").agg(F.countDistinct("shape").alias("shapes"), F.countDistinct("text").alias("texts")).where("shapes = 1 AND texts > 1").select("component", "texts")


def data_rows(members: DataFrame, least: int = 2) -> DataFrame:
    """(component, file_id, lines) -> components all of whose members are `least` lines of literals or more."""
    row = F.forall("lines", lambda line: F.forall(F.filter(F.split(line, "[ \t]+"), lambda w: w != ""), is_literal))
    told = members.groupBy("component").agg(F.bool_and(row & (F.size("lines") >= least)).alias("rows"))
    return told.where("rows").select("component")


def shown(components: DataFrame, *suppressed: DataFrame) -> DataFrame:
    """Components that no rule suppresses."""
    for s in suppressed:
        components = components.join(s.select("component"), "component", "left_anti")
    return components
