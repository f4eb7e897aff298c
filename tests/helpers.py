"""Small frames and plain-Python replays."""

from __future__ import annotations

from stmtflow.schema import STATEMENT, WIRE


def column(spark, values, expression, kind="string", name="v"):
    """One expression over one column of values, in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, {name} {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def statements(spark, rows):
    """A statement log from dicts with defaults."""
    full = [
        {
            "seq": i,
            "conn_id": 1,
            "op": 0,
            "query": "",
            "args": [],
            "start_us": i,
            "dur_us": 0,
            "rows_affected": 0,
            "error": "",
        }
        | row
        for i, row in enumerate(rows)
    ]
    return spark.createDataFrame([[r[f.name] for f in STATEMENT] for r in full], STATEMENT)


def messages(spark, rows):
    """A message log from (conn, kind, dict) in arrival order."""
    base = {"stmt": None, "query": None, "args": None, "oids": None, "tag": None}
    full = [{"msg": i, "conn_id": c, "us": i * 10, "kind": k} | base | extra for i, (c, k, extra) in enumerate(rows)]
    return spark.createDataFrame([[r[f.name] for f in WIRE] for r in full], WIRE)


def replay_nplus1(rows, threshold, window, cooldown):
    """Flags and alerts of (key, start_us, seq) rows taken one by one in order."""
    seen, last, flags, alerts = {}, {}, {}, []
    for key, t, seq in sorted(rows, key=lambda r: (r[1], r[2])):
        seen.setdefault(key, []).append(t)
        count = sum(1 for x in seen[key] if x >= t - window)
        flags[seq] = count >= threshold
        if flags[seq] and (key not in last or t - last[key] >= cooldown):
            last[key] = t
            alerts.append((key, t, seq, count))
    return flags, sorted(alerts)


def replay_arrival(rows, threshold, window, cooldown):
    """Flags and alerts of (key, start_us, seq) rows taken by seq, with the list of starts kept as the detector keeps it."""
    kept, last, flags, alerts = {}, {}, {}, []
    for key, t, seq in sorted(rows, key=lambda r: r[2]):
        times = kept.setdefault(key, [])
        while times and times[0] < t - window:
            times.pop(0)
        times.append(t)
        flags[seq] = len(times) >= threshold
        if flags[seq] and (key not in last or t - last[key] >= cooldown):
            last[key] = t
            alerts.append((key, t, seq, len(times)))
    return flags, sorted(alerts)
