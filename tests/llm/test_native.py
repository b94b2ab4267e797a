"""Operators 4, 8 and 9: properties on hard rows. DuckDB checks their values."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from strataloom.llm import exact_dedup, mixing, sharding


def test_dedup_keeps_one_of_each_text(table, hard):
    rows = [*hard, (30, "word\n"), (31, "a  b"), (32, "a\tb"), (33, "a b")]
    docs = table(rows, extra=["keep_id", "kept", "first"])
    got = exact_dedup.exact_dedup(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    assert Counter((r.keep_id, r.group_size) for r in got) == Counter((min((i for i in ids if i is not None), default=None), len(ids)) for ids in groups.values() for _ in ids)
    assert exact_dedup.kept_rows(docs).columns == docs.columns and exact_dedup.kept_rows(docs).count() == len(groups)
    assert exact_dedup.kept_rows(table([])).count() == 0


def test_new_shard_only_takes(table, hard):
    rows = [*hard, *[(100 + i, f"t{i}") for i in range(300)]]
    got = sharding.shard_records(table(rows, extra=["slot", "bucket"]), [1.0] * 8, added=1.0).collect()
    assert len(got) == len(rows)
    assert all(r.grown_shard in (r.shard, 8) for r in got) and 10 < sum(r.grown_shard == 8 for r in got) < 60
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    size = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows if i is not None}
    assert all((r.size, r.text_crc32) == size[r.doc_id] for r in got if r.doc_id is not None)


def test_heavier_shards_hold_more(table):
    got = Counter(r.shard for r in sharding.shard_records(table([(i, "") for i in range(2000)]), [1.0, 3.0]).collect())
    assert 0.68 < got[1] / 2000 < 0.82


def fair(rows, weights=(5, 2, 1)):
    """Targets and the cut queue, one entry after another: takes of each (doc_id, source, size) and targets."""
    sized = [(i, s, len(t.split())) for i, t, s in rows]
    sizes = defaultdict(int)
    for _, s, n in sized:
        sizes[s] += n
    weight = {s: weights[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, (s or "").encode())))}
    budget, capped, target = 1.5 * sum(sizes.values()), set(), {}
    while True:
        free = {s: w for s, w in weight.items() if s not in capped}
        level = (budget - sum(2 * sizes[s] for s in capped)) / sum(free.values())
        over = {s for s in free if 2 * sizes[s] <= level * weight[s]}
        if not over:
            break
        capped |= over
    target = {s: 2 * sizes[s] if s in capped else level * w for s, w in weight.items()}
    md5 = lambda i: hashlib.md5(str("" if i is None else i).encode()).hexdigest()
    entries = []
    for s in sizes:
        end, count = 0, Counter()
        for i, _, n in sorted((r for r in sized if r[1] == s), key=lambda r: (int(md5(r[0])[:8], 16) % 4096, md5(r[0]), r[0], r[2])):
            end, count[i, n] = end + n, count[i, n] + 1
            entries += [((p * sizes[s] + end) / target[s], md5(i), i, s, n, count[i, n], p) for p in (0, 1)] if target[s] else []
    taken, held = Counter(), 0
    for e in sorted(entries, key=lambda e: (e[0], e[1], e[2], e[3] or "", *e[4:])):
        held += e[4]
        if held > budget:
            break
        taken[e[2:5]] += 1
    return taken, target


def test_queue_is_cut_at_the_budget(table):
    rows = [(i, "w " * (i % 30), "abcd"[i % 4]) for i in range(900)] + [(5000 + i, "one two", None) for i in range(20)] + [(7, "same text here", "a")] * 30 + [(9000, "word " * 400, "d")]
    got = mixing.fair_queue(table(rows, extra=["finish", "copy"])).collect()
    taken, target = fair(rows)
    assert Counter((r.doc_id, r.source, r.size) for r in got if r["pass"]) == taken
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in got) and sum(r["pass"] == 0 for r in got) == len(rows)
    words = Counter()
    for (_, s, n), k in taken.items():
        words[s] += n * k
    assert sum(words.values()) <= 1.5 * sum(len(t.split()) for _, t, _ in rows) and all(abs(words[s] - target[s]) <= 400 for s in target)
    mixed = mixing.mix(table(rows)).collect()
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in mixed) == taken and mixing.mix(table([])).count() == 0


@pytest.mark.parametrize("files", [1, 3, 5])
def test_repeated_rows_are_dealt_like_the_queue(spark, tmp_path, files):
    rows = [(7, "same text here", "en", "a", None)] * 50 + [(i, "w " * i, "en", "a", None) for i in range(100, 110)] + [(i, "w " * 30, "en", "b", None) for i in range(200, 230)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(files).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    taken, _ = fair([(i, t, s) for i, t, _, s, _ in rows])
    assert Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.mix(docs, weights=(1, 5, 1)).collect()) == fair([(i, t, s) for i, t, _, s, _ in rows], (1, 5, 1))[0]
    assert 0 < taken[7, "a", 3]


def test_shards_by_brute_force(table, hard):
    """The shard with the largest -weight / ln(u), recomputed; slots in order of the key's hash."""

    def best(key, weights):
        draw = lambda s: (int(hashlib.md5(f"{key}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return max(range(len(weights)), key=lambda s: (-weights[s] / math.log(draw(s)), s))

    rows = [*hard, *[(100 + i, f"t{i}") for i in range(200)]]
    weights = [1.0, 2.0, 0.5, 1.0]
    for r in sharding.shard_records(table(rows), weights, added=3.0).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == best(key, weights) and r.grown_shard == best(key, [*weights, 3.0])


def test_mix_of_no_words(table):
    assert mixing.mix(table([(1, None), (2, "")])).count() == 0
