"""Snapshot differences against a plain loop, with forced failures of the small tables."""

import random
from datetime import datetime, timedelta

import pytest

from quarryline.operators import snapshots

from .conftest import rows

SNAP = "scan_id long, snapshot_no int, repo string, path string, content_hash string, indexed_at string, size long"
SCANS = "scan_id long, snapshot_no int, repo string, root string, delivered_at timestamp, unreadable_paths array<string>"
T0 = datetime(2025, 1, 1)


def clean(p):
    p = p.strip().replace("\\", "/")
    while "//" in p:
        p = p.replace("//", "/")
    return p.removeprefix("./")


def plain(snap, scans):
    winners = {}
    for s in scans:
        k = (s[2], s[3] or "", s[1])
        if k not in winners or (s[4], s[0]) > (winners[k][4], winners[k][0]):
            winners[k] = s
    out = set()
    for unit in {k[:2] for k in winners}:
        state = None
        for k in sorted(k for k in winners if k[:2] == unit):
            s = winners[k]
            last = {}
            for r in snap:
                if r[0] == s[0] and r[3] and r[3].strip():
                    p, h = clean(r[3]), (r[4] or "").strip().lower().removeprefix("sha256:") or None
                    if p not in last or (r[5], h or "") > last[p]:
                        last[p] = (r[5], h or "")
            new = {p: h or None for p, (_, h) in last.items()}
            for p in map(clean, filter(None, s[5] or [])):
                new[p] = None
            new = {p: h or (state or {}).get(p) for p, h in new.items()}
            new = {p: h for p, h in new.items() if h}
            if state is not None:
                for p in new.keys() | state.keys():
                    if new.get(p) != state.get(p):
                        out.add((k[2], unit[0], p, "added" if p not in state else "removed" if p not in new else "modified"))
            state = new
    return sorted(out, key=str)


def made(seed, n=60):
    rng = random.Random(seed)
    snap, scans, sid = [], [], 0
    for repo, root in (("r1", ""), ("r1", "lib"), ("r2", None)):
        files = {f"d/{root or 'x'}/f{k}.py": f"{k:04x}" for k in range(n)}
        for no in range(1, 6):
            if rng.random() < 0.15:
                continue
            for _ in range(2 if rng.random() < 0.3 else 1):
                sid += 1
                blind = [rng.choice(list(files)) for _ in range(3)]
                scans.append((sid, no, repo, root, T0 + timedelta(days=rng.randrange(90)), blind if rng.random() < 0.8 else None))
                for p, h in files.items():
                    if p in blind and rng.random() < 0.5:
                        continue
                    way = rng.choice([p, "./" + p, p.replace("/", "\\"), p.replace("/", "//")])
                    digest = rng.choice([f"sha256:{h}", h.upper(), f"SHA256:{h}", None if rng.random() < 0.2 else h])
                    snap.append((sid, no, repo, way, digest, f"2025-01-{rng.randrange(10, 28)}T00:00:00Z", 1))
                    if rng.random() < 0.1:
                        snap.append((sid, no, repo, p, "sha256:old", "2024-01-01T00:00:00Z", 1))
            for p in list(files):
                x = rng.random()
                if x < 0.1:
                    files[p] = f"{rng.randrange(1 << 20):05x}"
                elif x < 0.15:
                    del files[p]
            files[f"d/new{no}.py"] = "aa"
    return snap + snap[:20], scans


@pytest.mark.parametrize("parts", [(16, 64, 256), (1, 2, 64), (1,)])
def test_against_loop(spark, parts):
    snap, scans = made(len(parts))
    got = snapshots.changed_between(spark.createDataFrame(snap, SNAP), spark.createDataFrame(scans, SCANS), parts)
    assert rows(got, "snapshot_no", "repo", "path", "change") == plain(snap, scans)


def test_empty(spark):
    assert rows(snapshots.changed_between(spark.createDataFrame([], SNAP), spark.createDataFrame([], SCANS))) == []
