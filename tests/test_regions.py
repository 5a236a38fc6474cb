"""Regions against plain forms."""

from __future__ import annotations

import random

from veridraft.operators import regions

LOCATION = (
    "struct<type:string,page:int,paragraph:int,sheet:string,char_start:int,char_end:int,bbox:array<double>>"
)
SCHEMA = f"audit_id string, flag_id string, severity string, document_location {LOCATION}"
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW", "INFORMATIONAL"]


def test_text_regions(spark):
    rng = random.Random(1)
    rows = []
    for k in range(900):
        start = rng.randrange(3000) if k % 3 else rng.randrange(40)
        place = ("text", None, None) if k % 2 else ("docx", None, k % 4)
        end = None if k % 50 == 0 else start + rng.choice([0, 1, 2, 5, 9])
        rows.append((f"A{k % 3}", f"f{k}", rng.choice(SEVERITIES), (place[0], None, place[2], None, start, end, None)))
    rows += [("A0", "g1", "LOW", ("pdf", 1, None, None, 1, 5, None)), ("A0", "g2", "LOW", None)]
    flags = spark.createDataFrame(rows, SCHEMA)
    places = {}
    for audit, flag, severity, at in rows:
        if at and at[0] in ("text", "docx") and at[5] is not None and at[4] < at[5]:
            place = "text" if at[0] == "text" else f"paragraph {at[2]}"
            places.setdefault((audit, place), []).append((at[4], at[5], flag, SEVERITIES.index(severity)))
    want, members = set(), set()
    for (audit, place), spots in places.items():
        groups = []
        for spot in sorted(spots):
            if groups and spot[0] < max(s[1] for s in groups[-1]):
                groups[-1].append(spot)
            else:
                groups.append([spot])
        for n, g in enumerate(groups, 1):
            want.add((audit, place, n, g[0][0], max(s[1] for s in g), len(g), SEVERITIES[min(s[3] for s in g)]))
            members |= {(audit, place, n, s[2]) for s in g}
    columns = ["audit_id", "place", "region_no", "char_start", "char_end", "finding_count", "worst_severity"]
    assert {tuple(r) for r in regions.text_regions(flags).select(*columns).collect()} == want and len(want) > 100
    assert {tuple(r) for r in regions.text_region_flags(flags).collect()} == members
    assert regions.text_regions(flags.where("false")).count() == 0


def test_page_regions(spark):
    rng = random.Random(2)
    rows = []
    for k in range(300):
        x, y = rng.uniform(-20, 640), rng.uniform(-20, 800)
        box = [x + rng.uniform(0, 60), y, x, y + rng.uniform(0, 50)]
        box = None if k % 40 == 0 else box[:3] if k % 41 == 0 else box
        rows.append((f"A{k % 3}", f"f{k}", rng.choice(SEVERITIES), ("pdf", k % 2 if k < 200 else 7, None, None, None, None, box)))
    flags = spark.createDataFrame(rows, SCHEMA)

    def cell(v, size):
        return max(0, min(31, int(v * 32 // size)))

    boxes = {}
    for audit, flag, severity, at in rows:
        if at[6] and len(at[6]) == 4:
            x0, y0, x1, y1 = at[6]
            covered = {
                (cx, cy) for cx in range(cell(min(x0, x1), 612), cell(max(x0, x1), 612) + 1)
                for cy in range(cell(min(y0, y1), 792), cell(max(y0, y1), 792) + 1)
            }
            boxes.setdefault((audit, f"page {at[1]}"), []).append((flag, SEVERITIES.index(severity), covered))
    want, members = set(), set()
    for (audit, place), found in boxes.items():
        groups = []  # [cells, flags]
        for flag, rank, covered in found:
            wide = covered | {(x + a, y + b) for x, y in covered for a, b in ((0, 1), (1, 0), (0, -1), (-1, 0))}
            meets = [g for g in groups if g[0] & wide]
            groups = [g for g in groups if not g[0] & wide]
            groups.append([covered.union(*(g[0] for g in meets)), [(flag, rank)] + [f for g in meets for f in g[1]]])
        for cells, inside in groups:
            first = min(y * 32 + x for x, y in cells)
            want.add((audit, place, first, len(inside), SEVERITIES[min(r for _, r in inside)], len(cells)))
            members |= {(audit, place, first, f) for f, _ in inside}
    columns = ["audit_id", "place", "region", "finding_count", "worst_severity", "cells"]
    assert {tuple(r) for r in regions.page_regions(flags).select(*columns).collect()} == want and len(want) > 20
    assert {tuple(r)[:4] for r in regions.page_region_flags(flags).collect()} == members
