"""Cases that an operator once left out."""

import random

import pytest


def plain_set(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def test_keep_one_drops_near_copies(spark):
    """Groups are those of all pairs of exact similarity 0.8, among them texts linked only over a third one."""
    from tonearm.llm.near_copies import keep_one

    rng = random.Random(7)
    rows = []
    for g in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((len(rows), " ".join(words)))
        for _ in range(4):
            copy = list(words)
            for at in rng.sample(range(200), rng.choice([1, 2, 3, 4, 6, 12])):
                copy[at] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    sets = {i: plain_set(t) for i, t in rows}
    low = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((low[a], low[b]))
                low = {i: x if c == y else c for i, c in low.items()}
    kept = {r.doc_id for r in keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(low.values()) and len(kept) < len(rows) // 2


@pytest.mark.parametrize("block", [256, 16])
def test_groups_around_an_original(spark, block):
    """Copies of one text at all distances from it: most pairs are unlike, and components are those of all pairs, however blocks are cut."""
    from tonearm.llm.near_copies import groups

    rng = random.Random(3)
    rows = []
    for g, size in enumerate((150, 40, 40)):
        words = [f"g{g}w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(size):
            copy = list(words)
            for at in rng.sample(range(150), rng.choice([1, 3, 5, 8, 12])):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    sets = {i: plain_set(t) for i, t in rows}
    low = {i: i for i in sets}
    links = 0
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                links += 1
                x, y = sorted((low[a], low[b]))
                if x != y:
                    low = {i: x if c == y else c for i, c in low.items()}
    got = {r.doc_id: r.component_id for r in groups(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", block=block).collect()}
    assert got == low and links > 500 and len(set(low.values())) > 20


def test_cell_links():
    """Both ways of comparing find the same components; sets of very many shared shingles are worked off in columns."""
    import numpy as np

    from tonearm.llm import near_copies

    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 60, 30_000)
    rows = [(k % 2, k, k, np.unique(np.concatenate([rng.choice(base, 25_000 + 40 * k, replace=False), rng.integers(0, 1 << 60, 300)]))) for k in range(24)]

    def components(links):
        joined = near_copies._Joined()
        for x, y in links:
            joined.join(x, y)
        return [[joined.root(a) == joined.root(b) for b in range(24)] for a in range(24)]

    for least in (0.7, 0.74, 0.76):
        wide = near_copies.cell_links(rows, 0, 1, least)
        slow = [(a[1], b[1]) for a in rows[::2] for b in rows[1::2] if len(np.intersect1d(a[3], b[3])) >= least * len(np.union1d(a[3], b[3]))]
        assert components(wide) == components(slow) and len(wide) < 24
    same = near_copies.cell_links([(0, *r[1:]) for r in rows[:6]], 0, 0, 0.5)
    assert len(same) == 5


def test_terms_of_an_entity_in_one_text(spark):
    """A rare word discloses an entity of its one text, however far from it; common words do not."""
    from tonearm.llm.pii import personal_data, sanitise

    far = "common words of the weather " * 60
    rows = [(i, f"common words of the weather number {i}") for i in range(3000)]
    rows.append((5000, f"Trillian {far} writes from tm@earth.example.org about the weather"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = next(r.spans for r in personal_data(docs).collect() if r.doc_id == 5000).split(",")
    assert "term:0:8" in spans
    clean = next(r.text for r in sanitise(docs).collect() if r.doc_id == 5000)
    assert clean.startswith(f"[TERM] {far} ") and clean.endswith(" the weather") and "Trillian" not in clean


def arc(*records, version=b"1"):
    return b"filedesc://x 0.0.0.0 20240101 text/plain 4\n" + version + b" 0\n\n" + b"".join(records)


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_damaged_archives(spark, tmp_path, sent):
    """A cut-off record is marked and stays out of revisits; bad header lines are skipped and kept as metadata; the rest of the file is read."""
    import gzip

    from tonearm.llm import warc

    body = b"HTTP/1.1 200 OK\r\nX-Page-Id: %d\r\nContent-Length: 150\r\n\r\n" + b"z" * 150
    one = lambda i: b"http://a/%d 1.2.3.4 20240203 text/html; x=1 %d\n%s\n" % (i, len(body % i), body % i)
    damaged = arc(one(2), b"http://bad 1.2.3.4 no length\n", b"more rubbish\n", one(1), b"dns:a 1.2.3.4 2024 text/dns 5\n12345\n", one(3)[:-60])
    (tmp_path / "arc").mkdir()
    (tmp_path / "arc" / "part-0").write_bytes(damaged)
    (tmp_path / "arc" / "part-1").write_bytes(gzip.compress(arc(one(4))))
    (tmp_path / "arc" / "part-2").write_bytes(arc(b"http://v2 1.1.1.1 20240203040506 text/html 200 - - 9 f 3\nabc\n", version=b"2"))
    got = warc.read_arc(spark, str(tmp_path / "arc"))
    assert sorted((r.problem or "", r.page_id or 0) for r in got.collect()) == [("", 0), ("", 0), ("", 1), ("", 2), ("", 4), ("malformed", 0), ("truncated", 3)]
    assert got.where("problem = 'malformed'").first().payload == b"http://bad 1.2.3.4 no length\nmore rubbish\n"
    warc.convert_arc(spark, str(tmp_path / "arc"), str(tmp_path / "warc"), file_bytes=400, max_broadcast_revisits=sent)
    out = {(r.page_id or r.url): r for r in warc.read_warc(spark, str(tmp_path / "warc"), payloads=True).collect()}
    assert {k: (r.record_type, r.refers_to, r.truncated) for k, r in out.items()} == {1: ("response", None, False), 2: ("revisit", 1, False), 3: ("response", None, True), 4: ("revisit", 1, False), "dns:a": ("resource", None, False), "http://v2": ("resource", None, False)}
    assert out["dns:a"].date == "2024-01-01T00:00:00Z" and out["http://v2"].date == "2024-02-03T04:05:06Z" and out["http://v2"].payload == b"abc"
    files = [p.read_bytes() for p in (tmp_path / "warc").glob("part-*")]
    assert len(files) > 1
    kinds = []
    for data in files:
        # Every member is one record, whole by itself, and nothing stands between or after them.
        while data:
            d = __import__("zlib").decompressobj(31)
            record = d.decompress(data)
            data = d.unused_data
            (named, block), = warc.warc_records(record)
            assert record.endswith(block + b"\r\n\r\n") and {b"warc-record-id", b"warc-date", b"warc-type", b"content-length"} <= set(named)
            kinds.append(named[b"warc-type"])
    assert kinds.count(b"warcinfo") == len(files) and kinds.count(b"metadata") == 1


def test_near_fingerprints_propose_pairs_without_bands(spark, monkeypatch):
    """With no band in common, texts whose fingerprints are within three bits are still found, and those beyond are the bands' part."""
    import random

    import numpy as np

    from tonearm.llm import near_copies

    rng = random.Random(4)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(12):
        base = words(400)
        texts += [" ".join(base), " ".join(base[:-1] + ["other"]), " ".join(words(400))]
    sets = [near_copies.shingle_set(t.encode()) for t in texts]
    prints = np.array([near_copies.fingerprint(s) for s in sets])
    assert [int(p) for p in prints[:2]] == [int(sum(1 << k for k in range(64) if sum(int(h) >> k & 1 for h in s) * 2 > len(s)) + (1 << 63)) % (1 << 64) - (1 << 63) for s in sets[:2]]
    nodes = spark.createDataFrame([(i, len(s), int(p)) for i, (s, p) in enumerate(zip(sets, prints))], "sig long, n int, fp long")
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if int(np.bitwise_count((prints[i] ^ prints[j]).view(np.uint64))) <= near_copies.RADIUS}
    assert {tuple(r) for r in near_copies.near_fingerprints(nodes).collect()} == want and len(want) >= 8
    monkeypatch.setattr(near_copies, "bands", lambda hashes: np.empty(0, np.int64))
    made = near_copies.groups(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text")
    got = {r.id: r.component_id for r in made.collect()}
    assert all(got[i] == got[j] for i, j in want)
