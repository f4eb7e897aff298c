from __future__ import annotations

import random
import re

import pytest
from helpers import column
from pyspark.sql import functions as F

from stmtflow.functions import text
from stmtflow.schema import op_name

# Pieces of statements with what becomes of them; a statement is a random row of pieces.
PIECES = [
    ("pallet", "pallet"),
    ("bay_7", "bay_7"),
    ("$12", "$12"),
    ("0", "?"),
    ("17.25", "?"),
    ("'north dock'", "'?'"),
    ("''", "'?'"),
    ("'d''or 9'", "'?'"),
    ("kg2", "kg2"),
    ("'7'", "'?'"),
]
JOINTS = [(" ", " "), ("\t", " "), ("\r\n  ", " "), (",", ","), (" <= ", " <= "), ("(", "("), (" )", " )"), ("*", "*"), ("/", "/"), (" + ", " + ")]


def test_templates_of_joined_pieces(spark):
    rng = random.Random(12)
    made = []
    for _ in range(500):
        text_, want = "", ""
        for i in range(rng.randint(1, 8)):
            (joint, joint_want), (piece, piece_want) = rng.choice(JOINTS), rng.choice(PIECES)
            text_, want = text_ + (joint if i else "") + piece, want + (joint_want if i else "") + piece_want
        made.append((text_, want))
    assert column(spark, [t for t, _ in made], text.normalize_query(F.col("v"))) == [w for _, w in made]


def test_template_edges(spark):
    """No text at all, a literal that never ends, and blanks around."""
    made = {"": "", "'tail 3": "'?'", "\n\n": "", "   lift 9\t": "lift ?", "a=8;b": "a=?;b"}
    assert column(spark, list(made), text.normalize_query(F.col("v"))) == list(made.values())


def test_templates_of_random_text(spark):
    rng = random.Random(7)
    made = ["".join(rng.choice("ab '\t\n$?1234.5,()=<>+-*/;é") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    edge = r"[ \t\n\r,()=<>+\-*/;]"

    def plain(s):
        s = re.sub(r"'(?:[^']|'')*'?", "'?'", s)
        for _ in range(2):
            s = re.sub(rf"(\A|{edge})[0-9][0-9.]*(?=\Z|{edge})", r"\1?", s)
        return re.sub(r"[ \t\n\r]+", " ", s).strip(" ")

    assert column(spark, made, text.normalize_query(F.col("v"))) == [plain(s) for s in made]


def test_long_literals_do_not_exhaust_the_stack(spark):
    long = "SELECT '" + "x''" * 200_000 + "' FROM t"
    assert column(spark, [long], text.normalize_query(F.col("v"))) == ["SELECT '?' FROM t"]


HEADS = {"SELECT": True, "\n\t select": True, "Select": True, "INSERT INTO": False, "EXPLAIN SELECT": False, "": False}
TAILS = {" weight FROM crates": True, " x\nfrom y": True, " (from)": True, " fromage, a_from": False, " version()": False, " 8 + 1": False}


def test_watched_selects(spark):
    """Statements that run, begin with SELECT and name FROM as a word, in all combinations."""
    cases = [(op, h + t, op in (0, 1, 4) and HEADS[h] and TAILS[t]) for op in range(9) for h in HEADS for t in TAILS]
    df = spark.createDataFrame(cases, "op int, q string, want boolean")
    assert df.filter(text.is_table_select(F.col("op"), F.col("q")) != F.col("want")).count() == 0


def test_metadata(spark):
    """A SELECT that reads no table asks about the server."""
    cases = [(op, h + t, op in (0, 1, 4) and HEADS[h] and not TAILS[t]) for op in range(9) for h in HEADS for t in TAILS]
    df = spark.createDataFrame(cases, "op int, q string, want boolean")
    assert df.filter(text.is_metadata_query(F.col("op"), F.col("q")) != F.col("want")).count() == 0


def test_operations_by_text(spark):
    queries = ["BEGIN", " begin work", "COMMIT", "rollback to x", "START TRANSACTION", "SELECT 1"]
    assert column(spark, queries, text.classify_op(F.lit(0), F.col("v"))) == [5, 5, 6, 7, 0, 0]
    assert column(spark, queries, text.classify_op(F.lit(4), F.col("v"), "mysql")) == [5, 5, 6, 7, 5, 4]
    with pytest.raises(ValueError, match="unknown driver"):
        text.classify_op(F.lit(0), F.col("v"), "oracle")


def test_operation_names(spark):
    assert column(spark, [0, 7, 8, -1], op_name(F.col("v")), "int") == [
        "Query",
        "Rollback",
        "UnknownOp(8)",
        "UnknownOp(-1)",
    ]


def test_squash_and_cut(spark):
    values = [" a\n\n b ", "", "abcdefgh"]
    assert column(spark, values, text.squash_truncate(F.col("v"), 5)) == ["a b", "", "abcd…"]
    assert column(spark, values, text.squash_truncate(F.col("v"), 1)) == ["a", "", "a"]
    assert column(spark, ["abcdefgh", "", "abc"], text.truncate_dots(F.col("v"), 5)) == ["ab...", "-", "abc"]
    assert column(spark, ["a|b||"], text.escape_pipes(F.col("v"))) == ["a\\|b\\|\\|"]


def test_broken_bytes(spark):
    made = [b"ok \xc3\xa9", b"a\xe2\x82z", b"\xff\xfe", b"\xf0\x9f\x98\x80\xf0\x9f", b"\xed\xa0\x80", b"\xc0\xafx"]
    want = ["ok é", "a��z", "��", "😀��", "�" * 3, "��x"]
    assert column(spark, made, text.sanitize_utf8(F.col("v")), "binary") == want
