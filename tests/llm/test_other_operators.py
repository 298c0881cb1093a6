import base64
import hashlib
import gzip
import json
import zlib
import io
import random
import struct
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from weft.llm import license_scan, quality, substring_dedup, warc_zip

# --- quality ----------------------------------------------------------------------------------------------------------


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        n = rng.integers(1, 6, 8).astype(float)
        hits = np.array([rng.integers(0, k + 1) for k in n], float)
        fit = quality.isotonic(n, hits)
        # min over later starts of max over earlier ends of the pooled means
        mean = lambda a, b: hits[a : b + 1].sum() / n[a : b + 1].sum()
        expected = [max(min(mean(a, b) for b in range(i, 8)) for a in range(i + 1)) for i in range(8)]
        assert fit == pytest.approx(expected)


def test_partition_sums_give_the_ridge_solution():
    rng = np.random.default_rng(4)
    f = quality.Fourier(np.zeros(quality.N_STATS), np.ones(quality.N_STATS))
    x, y, fold = rng.normal(size=(50, quality.N_STATS)), rng.integers(0, 2, 50).astype(float), rng.choice([0, 2], 50)
    total = np.zeros((quality.FEATURES + 2,) * 2)
    for part in np.array_split(np.arange(50), 3):
        batch = pa.RecordBatch.from_arrays([pa.array(x[part].tolist(), pa.list_(pa.float64())), pa.array(y[part]), pa.array(fold[part], pa.int32())], ["stats", "y", "fold"])
        for out in quality._sums(f)(iter([batch])):
            for i, row in zip(out.column(1).to_pylist(), out.column(2).to_pylist(), strict=True):
                total[i] += row
    z = f(x)
    penalty = np.full(z.shape[1], quality.RIDGE * 50)
    penalty[-1] = 1e-9
    assert quality.solved(total) == pytest.approx(np.linalg.solve(z.T @ z + np.diag(penalty), z.T @ y))


def test_features_approximate_the_kernel():
    f = quality.Fourier(np.zeros(quality.N_STATS), np.ones(quality.N_STATS), features=20_000)
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, quality.N_STATS))
    near = f(np.stack([a, b]))[:, :-1]
    assert near[0] @ near[1] == pytest.approx(np.exp(-((a - b) ** 2).sum() / (4 * quality.N_STATS)), abs=0.03)


def test_quality_of_held_out_documents(spark):
    import weft.llm.queries as q

    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [r for r in q.op1_quality(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert len(rows) > 80 and np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def pooled(values, weights):
    """Nondecreasing least squares: the greatest, over starts, of the least, over ends, of weighted means."""
    n = len(values)
    mean = lambda a, b: np.average(values[a : b + 1], weights=weights[a : b + 1])
    return [max(min(mean(a, b) for b in range(k, n)) for a in range(k + 1)) for k in range(n)]


def test_quality_by_plain_algebra(spark):
    """The query's scores from all rows at once: dense ridge, folds fitted on each other, isotonic means by their definition."""
    import weft.llm.queries as q

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality is not None}
    stats = {r.doc_id: np.array(quality.statistics(r.text or ""), float) for r in docs}
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    ids = [r.doc_id for r in docs if r.doc_id in labels and fold(r.doc_id) != 1]
    x, y, k = np.array([stats[i] for i in ids]), np.array([labels[i] for i in ids], float), np.array([fold(i) for i in ids])
    features = quality.Fourier(x.mean(0), x.std(0))
    z = features(x)

    def ridge(rows):
        penalty = np.full(z.shape[1], quality.RIDGE * max(1, rows.sum()))
        penalty[-1] = 1e-9
        return np.linalg.solve(z[rows].T @ z[rows] + np.diag(penalty), z[rows].T @ y[rows])

    raw = np.where(k == 0, z @ ridge(k == 2), z @ ridge(k == 0))
    bins = np.clip((raw + 0.5) / 2 * quality.BINS, 0, quality.BINS - 1).astype(int)
    found = np.unique(bins)
    weights = np.array([(bins == b).sum() for b in found], float)
    curve = pooled(np.array([y[bins == b].mean() for b in found]), weights)
    at = (found + 0.5) / quality.BINS * 2 - 0.5
    whole = ridge(np.ones(len(y), bool))
    want = {i: float(np.interp(features(s[None]) @ whole, at, curve)[0]) for i, s in stats.items()}
    for r in q.op1_quality(spark, sf).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-6) and r.held_out == (fold(r.doc_id) == 1)


def test_quality_edges(docs, edge_rows, spark):
    stats = quality.statistics_table(docs(edge_rows))
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)] + [(1, 0), (None, 1), (3, None)], "doc_id long, y int")
    scores = quality.scored(stats, quality.fitted(stats, labels)).collect()
    assert len(scores) == len(edge_rows) and all(0 <= r.score <= 1 for r in scores)
    one = quality.fitted(stats, labels.where("y = 1"))
    assert set(one.scores(np.zeros((2, quality.N_STATS)))) == {1.0}
    none = quality.fitted(stats, labels.where("false"))
    assert set(none.scores(np.zeros((2, quality.N_STATS)))) == {0.5}
    assert quality.scored(quality.statistics_table(docs([])), none).count() == 0


# --- archives -----------------------------------------------------------------------------------------------------------


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, record_type string, payload_bytes int").repartition(3)


def test_archives_round_trip(spark):
    rows = [(1, "http://a/ b\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x\r\n\r\ny" * 5000), (None, "u", "alone"), (6, "u", "alone"), (7, "u", "z")]
    rows += [(100 + k, "u", f"page {k % 7}") for k in range(60)]
    found = warc_zip.read_archives(warc_zip.write_archives(pages(spark, rows), archive_bytes=4000), with_payload=True, range_bytes=2000).collect()
    first = {}
    for i, _, h in rows:
        first[h or ""] = min([x for x in (first.get(h or ""), i) if x is not None], default=None)
    expected = []
    for i, _, h in rows:
        p = (h or "").encode()
        response = i == first[h or ""]
        expected.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else first[h or ""], p if response else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found], key=str) == sorted(expected, key=str)


def test_pages_without_an_address(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "page_id long, html string")
    found = warc_zip.read_archives(warc_zip.write_archives(rows)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == [(1, "response", None), (2, "revisit", 1), (3, "response", None)]


def test_packages_of_several_members(spark, tmp_path):
    """Index entries name their member; compressed members are no archives, and an unknown name is an error."""
    parts, index = {"one.warc.gz": b"", "two.warc.gz": b""}, []
    for k in range(9):
        name = ("one.warc.gz", "two.warc.gz")[k % 2]
        record = gzip.compress(warc_zip.record_bytes(k, "u", b"page %d" % k, None))
        index.append({"filename": name, "offset": str(len(parts[name])), "length": str(len(record))})
        parts[name] += record
    for name, entries in (("good", index), ("bad", [*index, {"filename": "three.warc.gz", "offset": 0, "length": 1}])):
        with zipfile.ZipFile(tmp_path / f"{name}.wacz", "w") as z:
            for part, data in parts.items():
                z.writestr(f"archive/{part}", data)
            z.writestr("archive/log.txt", b"text" * 100, zipfile.ZIP_DEFLATED)
            z.writestr("indexes/index.cdxj", "".join(f"u 1970 {json.dumps(x)}\n" for x in entries))
    table = lambda name: spark.createDataFrame([(f"file://{tmp_path}/{name}.wacz", 9)], "archive string, records long")
    found = warc_zip.read_archives(table("good"), with_payload=True, range_bytes=300).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in found) == [(k, b"page %d" % k) for k in range(9)]
    with pytest.raises(Exception, match="three.warc.gz"):
        list(warc_zip.ranges(f"file://{tmp_path}/bad.wacz"))


def test_no_pages(spark):
    assert warc_zip.read_archives(warc_zip.write_archives(pages(spark, []))).count() == 0


def test_directory_of_deflated_and_stored_members():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("archive/data.warc.gz", b"abc" * 100)
        z.writestr("indexes/index.cdxj", b"page {}\n" * 50, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment PK"
    members = {m["name"]: m for m in warc_zip.directory(data, len(data.getvalue()))}
    assert members["archive/data.warc.gz"]["method"] == 0 and members["indexes/index.cdxj"]["method"] == 8
    at = warc_zip.member_start(data, members["archive/data.warc.gz"])
    assert data.getvalue()[at : at + 3] == b"abc"


def test_zip64_directory():
    """A directory whose sizes, offset and counts are all in ZIP64 fields."""
    name, body = b"archive/data.warc.gz", b"payload"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body)) + body
    extra = struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(name), 4 + len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + struct.pack("<HH", 99, 0) + extra
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, len(local) + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    data = local + central + end64 + locator + end
    (member,) = warc_zip.directory(io.BytesIO(data), len(data))
    assert (member["size"], member["packed"], member["header"], member["name"]) == (len(body), len(body), 0, name.decode())
    assert data[warc_zip.member_start(io.BytesIO(data), member) :].startswith(body)
    with pytest.raises(ValueError):
        warc_zip.directory(io.BytesIO(b"nothing"), 7)


# --- substrings ---------------------------------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioubcdfgklmnprst") for _ in range(rng.randint(1, 9))) for _ in range(n))


def test_gear_hash_by_definition():
    data = np.frombuffer(prose(random.Random(1), 40).encode(), np.uint8)
    h, slow = 0, []
    for b in data:
        h = ((h << 1) + int(substring_dedup.GEAR[b])) & 0xFFFFFFFF
        slow.append(h & 0xFFFF)
    assert (substring_dedup.gear_hashes(data)[16:] & 0xFFFF).tolist() == slow[16:]


def test_chunks_cover_the_text_and_resist_shifts():
    text = prose(random.Random(2), 2000) + "é漢" * 500
    data = text.encode()
    ends = substring_dedup.chunk_ends(data)
    assert ends[-1] == len(data) and all(0 < b - a <= substring_dedup.MAX_CHUNK for a, b in zip([0, *ends], ends, strict=False))
    pieces = {data[a:b] for a, b in zip([0, *ends], ends, strict=False)}
    assert all(p.decode() is not None for p in pieces)
    moved = b"an insertion at the front " + data
    other = substring_dedup.chunk_ends(moved)
    again = {moved[a:b] for a, b in zip([0, *other], other, strict=False)}
    assert len(pieces - again) <= 3


def test_planted_passages(docs):
    rng = random.Random(3)
    passages = [prose(rng, 60) for _ in range(40)]
    rows = [(k, prose(rng, 80)) for k in range(30)]  # clean
    for k, p in enumerate(passages):
        for copy in range(2 + k % 3):
            rows.append((100 + 10 * k + copy, f"{prose(rng, rng.randint(5, 90))} {p} {prose(rng, rng.randint(5, 90))}"))
    found = substring_dedup.repeated_passages(docs(rows)).collect()
    pairs = {(r.doc_id, r.first_doc_id) for r in found}
    assert pairs <= {(100 + 10 * k + c, 100 + 10 * k) for k in range(40) for c in (1, 2, 3)}  # nothing clean
    assert len(pairs) >= 0.97 * sum(1 + k % 3 for k in range(40))
    texts = dict(rows)
    for r in found:
        cut = texts[r.doc_id].encode()[r.start : r.end].decode()
        assert cut in passages[(r.doc_id - 100) // 10] or cut.strip() in passages[(r.doc_id - 100) // 10] or len(cut) > 100
        assert cut.strip()[10:-10] in texts[r.first_doc_id]


def test_spans_by_brute_force(docs, edge_rows):
    """Every span whose bytes occurred before, by order of id and place, and no other."""
    rng = random.Random(5)
    p = prose(rng, 70)
    long = prose(rng, 4000)
    rows = [*edge_rows, (60, f"{long} end"), (61, f"start {long}")] + [(50 + k, f"{prose(rng, 20)} {p if k % 2 else ''} {prose(rng, 20)}") for k in range(6)]
    seen, expected = {}, {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        for a, b in substring_dedup.spans(data):
            if data[a:b] in seen:
                runs = expected.setdefault(i, [])
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], b)
                else:
                    runs.append([a, b])
            else:
                seen[data[a:b]] = i
    expected = {(i, a, b) for i, runs in expected.items() for a, b in runs if b - a >= substring_dedup.LEAST}
    assert {(r.doc_id, r.start, r.end) for r in substring_dedup.repeated_passages(docs(rows)).collect()} == expected
    assert substring_dedup.repeated_passages(docs([])).count() == 0
    assert substring_dedup.without("aébc", [(1, 3)]) == "abc"


# --- licenses -----------------------------------------------------------------------------------------------------------


def brute_matches(text, templates):
    """Licenses of which the share of shingles stands in some window of the template's size or more."""
    found, own = license_scan.shingles(text), {}
    for name, body in templates.items():
        t = license_scan.shingles(body)
        for lo in range(max(1, len(found) - len(t) + 1)):
            if len(set(found[lo : lo + len(t)].tolist()) & set(t.tolist())) >= license_scan.SHARE * len(set(t.tolist())):
                own[name] = True
    return set(own)


def test_licenses_against_brute_force():
    rng = random.Random(7)
    templates = license_scan.Templates(license_scan.TEMPLATES)
    for name, body in license_scan.TEMPLATES.items():
        for lead in (0, 1, 7, 50, 200):
            words = body.split()
            if len(words) > 30:
                words[len(words) // 2] = "changed"
            text = f"{prose(rng, lead)} {' '.join(words).upper()} {prose(rng, 60)}"
            found = {n for n, *_ in license_scan.found_in(text, templates)}
            assert name in found and brute_matches(text, license_scan.TEMPLATES) <= found
    clean = prose(rng, 3000)
    assert not license_scan.found_in(clean, templates) and not brute_matches(clean, license_scan.TEMPLATES)


def test_license_spans(docs, edge_rows):
    rows = [*edge_rows, (40, "İ Released under the MIT License. and\nthis work is LICENSED under the GNU General Public License, version 3. End"), (41, "Released under the BSD License.")]
    found = license_scan.license_matches(docs(rows)).collect()
    text = dict(rows)[40]
    assert sorted((r.doc_id, r.license, text[r.start : r.end], r.containment) for r in found) == [
        (40, "GPL-3.0-statement", "this work is LICENSED under the GNU General Public License, version 3", 1.0),
        (40, "MIT-statement", "Released under the MIT License", 1.0),
    ]
    assert license_scan.license_matches(docs([])).count() == 0
    with pytest.raises(ValueError):
        license_scan.Templates({"short": "too few words"})
