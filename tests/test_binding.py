from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from stmtflow.functions import binding

# Values with how they are shown in a statement: numbers, words and quoted texts.
SHOWN = {
    "19": "19",
    "-0.75": "-0.75",
    "6e-3": "6e-3",
    "0x1p-2": "0x1p-2",
    "Inf": "Inf",
    "1e999": "'1e999'",
    "false": "false",
    "NULL": "NULL",
    "": "''",
    "dock 4": "'dock 4'",
    "l'été": "'l''été'",
    "$2": "'$2'",
    "why?": "'why?'",
}
WEB = [
    ("WHERE a = $1 AND b = $3", ["x"], "WHERE a = 'x' AND b = $3"),
    ("WHERE a = $1 OR b = $1", ["2"], "WHERE a = 2 OR b = 2"),
    ("WHERE a = ?", ["true"], "WHERE a = 'true'"),
    ("WHERE a = ?", [""], "WHERE a = ''"),
    ("WHERE a = $2", ["$1", "$1"], "WHERE a = '$1'"),
    ("? ?", ["0x1F"], "0x1F ?"),
    ("$0", ["a"], "''"),
]


def run(spark, cases, fn):
    df = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(cases)], "i int, q string, a array<string>")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("q"), F.col("a"))).collect()]


def test_bind_numbered(spark):
    """Numbered places, up to two digits, in any order and more than once; places without a value stay."""
    rng, cases = random.Random(3), []
    for _ in range(120):
        args = [rng.choice(list(SHOWN)) for _ in range(rng.randint(1, 12))]
        places = [rng.randint(1, len(args)) for _ in range(rng.randint(1, 6))]
        # A value that itself looks like a place would be taken for one, so it comes last.
        args = [a if a != "$2" or i == 0 else "19" for i, a in enumerate(args)]
        query = "lot " + ", ".join(f"${n} c" for n in places)
        cases.append((query, args, "lot " + ", ".join(f"{SHOWN[args[n - 1]]} c" for n in places)))
    assert run(spark, cases, binding.bind_args) == [w for _, _, w in cases]


def test_bind_marks(spark):
    """Question marks take the values from left to right; marks left over stay, values left over are not used."""
    rng, cases = random.Random(4), []
    for _ in range(120):
        args = [rng.choice(list(SHOWN)) for _ in range(rng.randint(0, 5))]
        marks = rng.randint(0, 6)
        shown = [SHOWN[a] for a in args] + ["?"] * 6
        query = "put " + " ".join(f"k{i}=?" for i in range(marks))
        cases.append((query, args, "put " + " ".join(f"k{i}={shown[i]}" for i in range(marks))))
    assert run(spark, cases, binding.bind_args) == [w for _, _, w in cases]


def test_bind_web(spark):
    assert run(spark, WEB, binding.bind_args_web) == [w for _, _, w in WEB]


def test_timestamp_casts(spark):
    """Every spelling of the type after every place marks that place, and no other type does."""
    spellings = ["timestamp", "TimestampTZ", "TIMESTAMP with time zone", "timestamp WITHOUT TIME ZONE"]
    joints = ["::", " :: ", "::  "]
    cases = [(f"loaded < ${n}{j}{t} OR kg = ${n % 3 + 1}::numeric", [n]) for n in (1, 2, 3) for j in joints for t in spellings]
    cases += [("a = $1::times AND b = $2::date", []), ("a = $1 + $2", []), ("f($3::timestamptz, $1::timestamp)", [1, 3])]
    df = spark.createDataFrame([(i, q, ["0", "0", "0"]) for i, (q, _) in enumerate(cases)], "i int, q string, a array<string>")
    rows = df.orderBy("i").select(binding.typed_args(F.col("q"), F.col("a")).alias("t")).collect()
    assert [[i + 1 for i, t in enumerate(r.t) if t.ts is not None] for r in rows] == [n for _, n in cases]


def test_timestamp_values(spark):
    values = ["0", "987654321012345", "-1000000", "-1", "2011-11-11T11:11:11Z", "1.5", "", " 5"]
    df = spark.createDataFrame([("$1::timestamp", [v], i) for i, v in enumerate(values)], "q string, a array<string>, i int")
    micros = F.unix_micros(binding.typed_args(F.col("q"), F.col("a"))[0]["ts"])
    got = [r[0] for r in df.orderBy("i").select(micros).collect()]
    epoch = int(dt.datetime(2000, 1, 1, tzinfo=dt.UTC).timestamp()) * 1_000_000
    assert got == [epoch, epoch + 987654321012345, epoch - 1_000_000, epoch - 1, None, None, None, None]


def test_shown_args(spark):
    df = spark.createDataFrame([([],), (["a", "b'"],)], "a array<string>")
    assert sorted(r[0] for r in df.select(binding.format_args(F.col("a"))).collect()) == ["", "['a', 'b'']"]
