"""Phrase bingo: case-folded decks, cards sampled without replacement, completed lines from marks."""

from __future__ import annotations

import json
import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.jsre import PY_WS, collapse
from ..functions.udf import arrow

SIDE, NEEDED, FREE = 5, 24, 12
#: The twelve lines: rows, columns, both diagonals; numbers follow from the side of the card.
LINES = [(f"row-{r}", [SIDE * r + c for c in range(SIDE)]) for r in range(SIDE)] + [(f"col-{c}", [SIDE * r + c for r in range(SIDE)]) for c in range(SIDE)] + [("diag-main", [(SIDE + 1) * k for k in range(SIDE)]), ("diag-anti", [(SIDE - 1) * (k + 1) for k in range(SIDE)])]


def deck(df: DataFrame, text_col: str, order: Column | None = None) -> DataFrame:
    """Distinct phrases of lines of text, whatever their case and spacing; the first spelling stays: ``(phrase, pos)``."""
    at = F.monotonically_increasing_id() if order is None else order
    rows = df.select(at.alias("row"), F.posexplode(F.split(text_col, r"\r\n|\r|\n")).alias("line", "raw")).select("row", "line", collapse(F.col("raw")).alias("phrase")).where("phrase != ''")
    first = rows.groupBy(F.lower("phrase").alias("key")).agg(F.min(F.struct("row", "line", "phrase")).alias("x"))
    return first.select("x.phrase", F.struct("x.row", "x.line").alias("pos"))


def valid_deck(d: DataFrame) -> DataFrame:
    """``(n, valid)``: a card needs 24 phrases."""
    return d.agg(F.count(F.lit(1)).alias("n")).withColumn("valid", F.col("n") >= NEEDED)


def card(phrases: list[str], seed: int = 0) -> list[str]:
    """25 cells, the middle one free."""
    if len(set(phrases)) < NEEDED:
        raise ValueError(f"a card needs {NEEDED} different phrases")
    chosen = random.Random(seed).sample(list(phrases), NEEDED)
    return [*chosen[:FREE], "FREE", *chosen[FREE:]]


def deal(d: DataFrame, cards: int, seed: int = 0) -> DataFrame:
    """``(card, cells)``: each card draws its phrases by a seeded hash order; ranks are limited before they are shuffled."""
    each = d.select("phrase", F.explode(F.sequence(F.lit(0), F.lit(cards - 1))).alias("card"))
    w = Window.partitionBy("card").orderBy(F.xxhash64(F.lit(seed), "card", "phrase"), "phrase")
    drawn = each.withColumn("k", F.row_number().over(w)).where(F.col("k") <= NEEDED)
    cells = F.transform(F.array_sort(F.collect_list(F.struct("k", "phrase"))), lambda x: x["phrase"])
    return drawn.groupBy("card").agg(cells.alias("c")).where(F.size("c") == NEEDED).select("card", F.array_insert("c", FREE + 1, F.lit("FREE")).alias("cells"))


def completed(marks: Column) -> Column:
    """Names of the completed lines of an array of 25 marks."""
    lines = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*[F.lit(i) for i in at]).alias("at")) for n, at in LINES])
    return F.transform(F.filter(lines, lambda x: F.forall(x["at"], lambda i: F.get(marks, i))), lambda x: x["name"])


def completed_of_mask(mask: Column) -> Column:
    """The same from the bits of a number; the middle cell always counts.  A line is complete if its bits are all set."""
    bits = mask.bitwiseOR(F.lit(1 << FREE))
    return F.array_compact(F.array(*[F.when(bits.bitwiseAND(F.lit(sum(1 << i for i in at))) == sum(1 << i for i in at), F.lit(n)) for n, at in LINES]))


def marks_of_mask(mask: Column) -> Column:
    """25 booleans from the bits of a number; the middle cell always counts."""
    return F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda i: (F.pmod(F.floor(mask / F.pow(F.lit(2), i)), F.lit(2)) == 1) | (i == FREE))


def fresh() -> list[bool]:
    return [k == FREE for k in range(SIDE * SIDE)]


def toggle(marks: list[bool], cell: int) -> list[bool]:
    return [not m if k == cell and k != FREE else m for k, m in enumerate(marks)]


@arrow("string")
def serial(cells: pd.Series) -> pd.Series:
    """Four characters that name a card: 32-bit FNV-1a of its cells, in base 36."""

    def one(card) -> str:
        h = 2166136261
        for unit in memoryview("|".join("·" if c == "FREE" else c for c in card).encode("utf-16-le")).cast("H"):
            h = (h ^ unit) * 16777619 & 0xFFFFFFFF
        digits = ""
        while h:
            h, r = divmod(h, 36)
            digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[r] + digits
        return digits.rjust(4, "0")[-4:]

    return cells.map(one)


def dump(cells: list[str], marks: list[bool]) -> str:
    return json.dumps({"version": 1, "cells": cells, "marks": marks}, ensure_ascii=False)


def load(text: str) -> tuple[list[str], list[bool]] | None:
    """A saved game, or None where the text is not one; marks that are no booleans count as unmarked."""
    try:
        got = json.loads(text)
        cells, marks = got["cells"], got["marks"]
        if got["version"] != 1 or len(cells) != SIDE * SIDE or len(marks) != SIDE * SIDE or not all(isinstance(c, str) for c in cells):
            return None
    except (ValueError, KeyError, TypeError):
        return None
    return cells, [m is True or k == FREE for k, m in enumerate(marks)]


def progress(marks: list[bool]) -> str:
    done = [n for n, at in LINES if all(marks[i] for i in at)]
    n = sum(marks)
    return f"{n} of {SIDE * SIDE} marked" + (f", {len(done)} {'line' if len(done) == 1 else 'lines'}: {', '.join(done)}" if done else "")


def normalize(phrase: str) -> str:
    return re.sub(f"[{PY_WS}]+", " ", phrase).strip(" ")
