"""The operations sample, rebuilt to its published totals (not its row values).

2,400 clean rows (4 months, 6 regions, 100 rows each), 7 category variants,
5 missing scores and 17 copied rows appended at the end.
"""

from __future__ import annotations

import csv
import io
from datetime import date, timedelta

REGIONS = ["North", "South", "East", "West", "Central", "Coast"]
HEADERS = [
    "operation_id", "date", "region", "site", "revenue", "target_revenue", "order_volume", "operating_cost",
    "downtime_minutes", "maintenance_cost", "csat_score",
]
# Published month x region totals
# (revenue, target_revenue, operating_cost, order_volume, downtime_minutes).
MONTHLY = {
    ("2026-03", "North"): (980000, 1000000, 627200, 9200, 970),
    ("2026-03", "South"): (903000, 1030000, 623070, 9450, 920),
    ("2026-03", "East"): (926000, 1040000, 648200, 9700, 990),
    ("2026-03", "West"): (949000, 1050000, 673790, 9950, 1060),
    ("2026-03", "Central"): (972000, 1060000, 699840, 10200, 1130),
    ("2026-03", "Coast"): (995000, 1070000, 726350, 10450, 1200),
    ("2026-04", "North"): (970000, 1000000, 659600, 9500, 1080),
    ("2026-04", "South"): (930000, 1030000, 641700, 9650, 940),
    ("2026-04", "East"): (953000, 1040000, 667100, 9900, 1010),
    ("2026-04", "West"): (976000, 1050000, 692960, 10150, 1080),
    ("2026-04", "Central"): (999000, 1060000, 719280, 10400, 1150),
    ("2026-04", "Coast"): (1022000, 1070000, 746060, 10650, 1220),
    ("2026-05", "North"): (950000, 1000000, 693500, 10000, 1194),
    ("2026-05", "South"): (957000, 1030000, 660330, 9850, 960),
    ("2026-05", "East"): (980000, 1040000, 686000, 10100, 1030),
    ("2026-05", "West"): (1003000, 1050000, 712130, 10350, 1100),
    ("2026-05", "Central"): (1026000, 1060000, 738720, 10600, 1170),
    ("2026-05", "Coast"): (1049000, 1070000, 765770, 10850, 1240),
    ("2026-06", "North"): (881000, 1000000, 740000, 10800, 1565),
    ("2026-06", "South"): (1060000, 1030000, 765000, 10050, 980),
    ("2026-06", "East"): (1020000, 1040000, 750000, 10300, 1320),
    ("2026-06", "West"): (1040000, 1050000, 760000, 10550, 1120),
    ("2026-06", "Central"): (1049000, 1060000, 745000, 10800, 1190),
    ("2026-06", "Coast"): (950000, 1070000, 740000, 11050, 1260),
}
PERIODS = sorted({p for p, _ in MONTHLY})
VARIANTS = [17, 89, 260, 588, 823, 1118, 1534]
MISSING = [38, 445, 997, 1643, 2255]
COPIES = [7 + 137 * j for j in range(17)]
ANOMALY = (("2026-06", "East"), 42, 210)


def weekdays(period: str, n: int = 20) -> list[str]:
    day = date.fromisoformat(f"{period}-01")
    out = []
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day.isoformat())
        day += timedelta(days=1)
    return out


def parts(total: int, n: int, seed: int) -> list[int]:
    """Whole parts around the mean that add up to ``total``; none equal a copied row."""
    out = [total // n + (i * 7 + seed) % 11 - 5 for i in range(n)]
    step = 1 if sum(out) < total else -1
    i = 0
    while sum(out) != total:
        out[i % n] += step
        i += 1
    return out


def clean_rows() -> list[dict]:
    rows = []
    for m, period in enumerate(PERIODS):
        days = weekdays(period)
        for r, region in enumerate(REGIONS):
            revenue, target, cost, orders, downtime = MONTHLY[(period, region)]
            seed = m * 6 + r
            cents = [parts(v * 100, 100, seed) for v in (revenue, target, cost)]
            volume = parts(orders, 100, seed)
            minutes = parts(downtime, 100, seed)
            if (period, region) == ANOMALY[0]:
                rest = parts(downtime - ANOMALY[2], 99, seed)
                minutes = rest[: ANOMALY[1]] + [ANOMALY[2]] + rest[ANOMALY[1]:]
            for i in range(100):
                money = lambda v: f"{v // 100}.{v % 100:02d}"
                rows.append(
                    {
                        "operation_id": f"OP-{len(rows) + 1:05}", "date": days[i // 5], "region": region,
                        "site": f"{region[:2].upper()}-{i % 5 + 1:02}", "revenue": money(cents[0][i]),
                        "target_revenue": money(cents[1][i]), "order_volume": str(volume[i]),
                        "operating_cost": money(cents[2][i]), "downtime_minutes": str(minutes[i]),
                        "maintenance_cost": money(cents[2][i] // 10), "csat_score": str(76 + len(rows) % 21),
                    }
                )
    for i in MISSING:
        rows[i]["csat_score"] = ""
    return rows


def raw_rows() -> list[dict]:
    rows = [dict(r) for r in clean_rows()]
    for j, i in enumerate(VARIANTS):
        name = rows[i]["region"]
        rows[i]["region"] = f" {name.lower()} " if j % 2 else name.upper()
    return rows + [dict(rows[i]) for i in COPIES]


def as_csv(rows: list[dict]) -> str:
    out = io.StringIO(newline="")
    writer = csv.DictWriter(out, fieldnames=HEADERS, lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()
