"""Admission and classification of pairs, and text identity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirrorfold.functions import scalars as S


def text_identity(a: Column, b: Column) -> Column:
    return F.when(a == b, "identical").when(S.folded(a) == S.folded(b), "indentation_only").otherwise("different")


def content_required(h: Column, overlap: Column, j: Column, e: Column) -> Column:
    return (e < S.COSINE) & ((h == 1) | (h >= S.SHAPE_SAME) | (overlap >= S.SHAPE_SAME) | (j >= S.TOKENS_SAME))


def content_floor(h: Column, e: Column) -> Column:
    """Token-only pairs answer for more."""
    return F.when((h == 0) & (e == 0), F.lit(S.PROMOTE)).otherwise(F.lit(S.SUPPORT))


def content_verdict(h: Column, overlap: Column, j: Column, e: Column, agreement: Column, rename: Column, role_mismatch: Column, contradiction: Column) -> Column:
    """The gate's route for a pair, by the first rule that decides."""
    support = F.greatest(agreement, rename)
    return (
        F.when(role_mismatch & (h == 0) & (j < S.FUSED), "role_mismatch").when(~content_required(h, overlap, j, e), "not_required")
        .when((h == 1) & (agreement == 1), "exact_frontier").when(contradiction, "contradiction").when(support >= content_floor(h, e), "measured").otherwise("content_below_floor")
    )


def admitted(verdict: Column) -> Column:
    return verdict.isin("not_required", "exact_frontier", "measured")


def classification(identity: Column, shape: Column, support: Column, e: Column, renamed: Column, ok: Column) -> Column:
    """The kind of an admitted pair; a rejected one may still be alike in shape alone."""
    return (
        F.when(ok & (identity == "identical"), "identical")
        .when(ok & (renamed | ((shape >= S.NEAR_SHAPE) & (support >= S.NEAR_CONTENT))), "nearly_identical")
        .when(ok & (e >= S.COSINE), "same_behavior").when(ok & (support >= S.SIMILAR_CONTENT), "loosely_similar")
        .when(~ok & (support <= S.SHAPE_ONLY_MAX) & (shape >= S.NEAR_SHAPE) & ~renamed, "structural_only").otherwise("none")
    )
