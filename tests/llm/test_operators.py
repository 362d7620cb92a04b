"""Each training-data operator against a brute-force version, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rallylake.llm import decontaminate, licenses, neardup, packing, quality, repeats, rollup, secrets, simhash, topk, warc
from rallylake.llm.common import components, scratch_path

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SHA_EMPTY = hashlib.sha256(b"").hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, texts, ids=None):
    rows = [(k, t, "en", "src0", len(t or "")) for k, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, DOC)


def odd_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    long = " ".join(word() for _ in range(60_000))
    passage = " ".join(word() for _ in range(60))
    return [
        None, "", " ", "\t\n", "A", "Ünï\x00cödé \U0001f600 tokens", "a" * 700, "x y " * 300, long, long + " end", passage, "pre " + passage + " post", passage.upper(), passage, passage,
        'Password: "hunter22" api_key=abc-DEF_123 token = x1', "AKIA" + "Q7" * 9 + " 0123456789abcdef0123456789abcdef", "secret secret=:secret:=abcdefgh", "gh ghp_abcdEFGH1234ijklMNOP5678qrstUVWX90 x",
        "Licensed under the Apache License, CC BY and CC BY; MIT License. mit licence", "GNU Generel Public Licence", "the mit licens", "gnu general\npublic-license",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_texts()).withColumn("n_words", F.lit("clash")).withColumn("spans", F.lit(1)).withColumn("h", F.lit(2)).withColumn("keep", F.lit(3)).withColumn("length", F.lit(4))


def by_id(df, key="doc_id"):
    out = {}
    for r in df.collect():
        assert r[key] not in out
        out[r[key]] = r
    return out


# ---- 1


def brute_secrets(text):
    text = text or ""
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [("assign", [m.span() for m in assign.finditer(text) if len(m[2]) > 5]), ("access", [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) > 19]), ("hex", [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) > 23])]
    spans = sorted((a, k, b) for k, (_, found) in enumerate(kinds) for a, b in found)
    return [len(f) for _, f in kinds], ",".join(f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans)


def test_secrets_match_brute_force(spark, odd, small):
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for k, r in by_id(secrets.secret_scan(docs)).items():
            counts, joined = brute_secrets(texts[k])
            assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            assert [x for x in r["spans"].split(",") if x and not x.startswith("inferred")] == [x for x in joined.split(",") if x]


def test_inferred_formats_generalise():
    model = secrets.fit()
    held_out = secrets.labelled_credentials(150, seed=991)
    right = [bool(model.told(*(np.array([x]) for x in (model.score(text)[0], len(text))))[0]) != name.startswith("word") for text, name in held_out]
    assert sum(right) / len(right) > 0.98
    (found,) = secrets.scan([b"see ghp_abcdEFGH1234ijklMNOP5678qrstUVWX90 there"], model)
    assert not found.base and secrets.joined(found.spans) == "inferred:4:42"
    # lengths and prefixes are states, and trees are much larger than what they merge to
    assert model.formats["hex"].states >= 64 and all(20 < a.states < 120 for a in model.formats.values())
    hexa = "0123456789abcdef" * 4
    ends = model.formats["hex"].log[:, 0]
    assert min(ends[32], ends[40], ends[64]) > max(ends[k] for k in range(65) if k not in (32, 40, 64)) and model.score(hexa)[1] == "hex"


def test_planted_formats_and_ordinary_names():
    """Formats that no rule makes are found; names of other words than the rules' are left alone."""
    model, r = secrets.fit(), random.Random(12)
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    alnum, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef"
    planted = [lambda: "npm_" + of(alnum, 36), lambda: "AIza" + of(alnum + "-_", 35), lambda: of(alnum, 22), lambda: "dop_v1_" + of(hexa, 64), lambda: "ASIA" + of(alnum[:26] + alnum[-10:], 16), lambda: "shpat_" + of(hexa, 32), lambda: of(alnum, 14), lambda: of(alnum + "-_", 60), lambda: of(alnum + "+/", 300)]
    names = "static assets report index server config module version release update handler controller service default images scripts content plugin template library archive network storage deploy metrics".split()
    name = lambda: r.choice(names)
    plain = [lambda: f"{name()}/{name()}/v{r.randint(1, 3)}/{name()}-{r.randint(1, 99)}/{name()}x{r.randint(1, 9)}", lambda: name() + "".join(name().title() for _ in range(3)) + r.choice(["", "2"]), lambda: f"{name()}_{name()}_{r.randint(0, 2030)}", lambda: str(r.randint(10**9, 10**16)), lambda: f"{name().upper()}_{name().upper()}", lambda: f"{name()}-v{r.randint(1, 9)}-rc{r.randint(1, 5)}", lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T10", lambda: name() + name(), lambda: r.choice(["=", "-", "_-", "=+", "ab", "X"]) * r.randint(8, 300)]
    for makers, low, high in ((planted, 0.9, 1), (plain, 0, 0.05)):
        for make in makers:
            texts = [make() for _ in range(200)]
            told = model.told(model.scores([x.encode() for x in texts])[0], np.array([len(x) for x in texts]))
            assert low <= told.mean() <= high, texts[0]


def test_automaton_counts_are_those_of_the_labels():
    """Merging moves counts and loses none: by depth the frequencies are those of the strings."""
    strings = [x for x, n in secrets.labelled_credentials(120) if n == "prefixed"]
    a = secrets.Automaton(strings)
    reach = {0: len(strings)}
    for depth in range(45):
        symbols = Counter(int(secrets.codes(x)[depth]) for x in strings if len(x) > depth)
        now, after = Counter(), Counter()
        for state, n in reach.items():
            for c in range(1, secrets.SYMBOLS):
                share = (np.exp(a.log[state, c]) * secrets.WIDTH[c] - 0.02 * secrets.WIDTH[c] / (secrets.WIDTH[1:].sum() + 1)) / 0.98
                if share > 1e-9:
                    now[c] += n * share
                    after[int(a.step[state, c])] += n * share
        assert all(abs(now[c] - symbols[c]) < 1e-6 for c in now.keys() | symbols.keys())
        reach = after


def test_every_run_is_scored_and_copies_do_not_hide(spark):
    key = "zq_Xk7fQ2mLp9RtVw3YbNc8ZdHs5Jg"
    texts = ["plain words beforehand"] * 3 + [f"line {key} end"] * 60 + [None, "", f"token = {key}", "short ab1"] + ["x" * 5_000_000]
    docs = documents(spark, texts)
    out = by_id(secrets.secret_scan(docs))
    runs = [re.findall("[A-Za-z0-9+/_=-]{8,}", t or "") for t in texts]
    assert [out[k]["n_candidates"] for k in range(len(texts))] == [len(x) for x in runs]
    assert [out[k]["n_inferred"] for k in range(3, 63)] == [1] * 60
    told = out[65]
    assert told["n_inferred"] == 0 and told["n_scored_base"] == 1 and told["matches"][0]["within_base"] and told["max_score"] > 0
    assert out[63]["max_score"] is None and out[len(texts) - 1]["n_inferred"] == 0
    assert secrets.secret_scan(documents(spark, [])).count() == 0


def test_secrets_are_masked(spark):
    docs = documents(spark, [None, "token = abcdefgh and token=abcdefgh", "clean text"])
    assert [r["text"] for r in secrets.redact(docs).orderBy("doc_id").collect()] == [None, "[SECRET] and [SECRET]", "clean text"]


def test_labelled_credentials_from_a_table(spark):
    rows = [(f"zz9-{k:020d}", "own") for k in range(300)] + [(None, "own"), ("", "own"), ("x", None)]
    model = secrets.fit(spark.createDataFrame(rows, "credential string, format string"))
    assert list(model.formats) == ["own"] and model.score("zz9-00000000000000000777")[0] > 0.5
    assert model.score("ordinary-names")[0] < 0


# ---- 2


def test_warc_round_trip(spark):
    long = "é" * 5000
    rows = [(1, "u", "x" * 10), (2, "u\r\n", None), (3, None, ""), (4, "a", warc.VERSION + warc.FIRST + "response\r\n" + (warc.VERSION + warc.FIRST) * 2 + long), (5, "a", "\r\n\r\nWARC/1.1\r\n\r\n\r\n"), (6, "b", "x" * 10), (None, "b", "x" * 10), (7, "c", long), (8, "c", long + "\r\n"), (9, "q", long), (10, "z", "\n\r\n\r"), (11, "z", "nul\x00")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    import base64

    for chunk in (8, 37, 1 << 16, 1 << 20):
        out = by_id(warc.round_trip(pages, scratch_path(spark, "w"), chunk_bytes=chunk), "page_id")
        assert len(out) == len(rows)
        first = {}
        for page, _, html in sorted((r for r in rows if r[0]), key=lambda r: r[0]):
            first.setdefault(html or "", page)
        for page, _, html in rows:
            raw, r = (html or "").encode(), out[page]
            assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
            whose = first[html or ""]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if whose == page else ("revisit", whose))


def test_warc_threshold_repeats_and_empty(spark):
    rows = [(1, "aa"), (2, "aa"), (3, "bbbb"), (3, "bbbb"), (4, "bbbb")]
    out = warc.round_trip(spark.createDataFrame(rows, "page_id long, html string"), scratch_path(spark, "w"), at_least=3)
    assert sorted((r["page_id"], r["record_type"]) for r in out.collect()) == [(1, "response"), (2, "response"), (3, "response"), (3, "response"), (4, "revisit")]
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string"), scratch_path(spark, "w")).count() == 0


def test_warc_long_pages_of_one_id(spark):
    # repeated rows, one id with two payloads, and null ids, all beyond the chunk
    a, b, c, d, e = ("".join(random.Random(k).choices("abcdef ", k=100 + 37 * k)) for k in range(5))
    rows = [(1, a), (1, a), (1, a), (2, a), (2, b), (2, c), (None, d), (None, e), (None, e), (None, a), (4, "x"), (4, "x"), (5, "x")]
    path = scratch_path(spark, "w")
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    out = warc.round_trip(pages, path, chunk_bytes=40)
    import base64

    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    first = {a: 1, b: 2, c: 2, "x": 4}
    want = [(p, len(x), digest(x), *(("response", None) if first.get(x) == p else ("revisit", first[x]))) for p, x in rows]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    for chunk in (8, 1 << 16, 1 << 20):
        again = warc.round_trip(pages, scratch_path(spark, "w"), chunk_bytes=chunk)
        assert sorted(map(str, map(tuple, again.collect()))) == sorted(map(str, want))
    chunks = warc.chunk_table(spark, path)
    assert chunks.count() == chunks.select("record_id", "chunk_no").distinct().count()
    records = {r[0] for r in chunks.select("record_id").collect()}
    assert len(records) == len(rows) and {r[0] for r in chunks.where("refers_to is not null").select("refers_to").collect()} < records


def test_warc_running_digests(spark):
    path = scratch_path(spark, "w")
    raw = random.Random(1).randbytes(5000).hex()
    warc.write_archives(spark.createDataFrame([(1, "u", raw)], "page_id long, url string, html string"), path, chunk_bytes=999)
    chunks = warc.chunk_table(spark, path)
    assert chunks.where("not complete or octet_length(chunk) > 999").count() == 0
    rows = warc.running_digests(chunks).orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in rows] == list(range(1, 12)) and rows[-1]["bytes_so_far"] == 10_000
    assert [r["last"] for r in rows] == [False] * 10 + [True]
    table = warc.chunked(spark.createDataFrame([(1, "u", raw), (None, "u", None)], "page_id long, url string, html string"), chunk_bytes=999).where("page_id = 1").orderBy("chunk_no").collect()
    assert [r["digest_so_far"] for r in table] == [r["digest_so_far"] for r in rows] and b"".join(r["chunk"] for r in table) == raw.encode()


# ---- 3


def brute_repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in by_id(df).items()}


@pytest.mark.parametrize("seed", range(3))
def test_repeats_match_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    parts = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 120))) for _ in range(12)] + ["é" * 9, "ab" * 40, "\x00"]
    texts = [None, "", "abc"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(120)]
    if seed == 2:  # pieces of texts, and groups dealt to pairs of blocks
        monkeypatch.setattr(repeats, "SLICE", 300)
        monkeypatch.setattr(repeats, "BLOCK", 3)
    got = rows_of(repeats.remove_repeats(documents(spark, texts), length=50, gram=11))
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts, 50)


def test_repeats_around_a_hot_anchor(spark, monkeypatch):
    """Very many distinct contexts around one passage: anchors are chosen anew, and only then pairs of blocks."""
    rng = random.Random(11)
    of = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, other = of(46), of(70)
    texts = [of(rng.randint(30, 90)) + passage + of(rng.randint(0, 90)) for _ in range(150)] + [of(40) + other[:60] + of(9) + passage + of(60) for _ in range(20)]
    texts += [x[5:] for x in rng.sample(texts, 30)] + texts[:9]
    monkeypatch.setattr(repeats, "BLOCK", 8)
    monkeypatch.setattr(repeats, "HOT", 20)
    for levels in (1, 4):
        monkeypatch.setattr(repeats, "LEVELS", levels)
        got = rows_of(repeats.remove_repeats(documents(spark, texts), length=60, gram=40))
        assert [got[k] for k in range(len(texts))] == brute_repeats(texts, 60)


def test_repeats_on_odd_texts(spark, odd):
    texts = [r["text"] for r in odd.orderBy("doc_id").collect()]
    got = rows_of(repeats.remove_repeats(odd))
    small = [k for k, t in enumerate(texts) if len(t or "") < 5000]
    # the two long texts share all but their ends, and nothing with the others
    want = brute_repeats([texts[k] for k in small], 200)
    assert [got[k] for k in small] == want
    assert got[8][1] == got[8][0] and got[9][0] - got[9][1] == 4


def test_repeats_of_repeated_rows_and_empty(spark):
    docs = documents(spark, ["z" * 150 + "y" * 100, "z" * 150 + "y" * 100, "w" * 199], [1, 1, None])
    rows = [(r["doc_id"], r["n_removed"]) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(rows, key=str) == [(1, 250), (1, 250), (None, 0)]
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_run_length_index():
    index = repeats.RunLengthIndex([b"banana", b"bandana"])
    text = b"banana\0bandana\0"
    for p in range(len(text)):
        own = text[p : text.index(b"\0", p)]
        others = [text[q : text.index(b"\0", q)] for q in range(len(text)) if q != p]
        best = max(next((n for n in range(min(len(own), len(o)), -1, -1) if own[:n] == o[:n])) for o in others)
        assert index.longest[p] == best
    periodic = repeats.RunLengthIndex([b"ab" * 500])
    assert periodic.runs < 10  # the runs of a repetitive text are few


# ---- 4


def test_licenses_match_brute_force(spark, odd, small):
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet")):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        for k, r in by_id(licenses.license_scan(docs)).items():
            w = WORD.findall(lower(texts[k]))
            places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
            assert (r["n_words"], r["n_base"]) == (len(w), len(places))
            assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
            base = sorted({x for _, x in places})
            assert r["base_labels"] == ",".join(base) and set(base) <= set(r["labels"].split(","))
            assert 0 <= r["score"] <= 1 and r["labels"] == ",".join(sorted(set(r["labels"].split(","))))


def edited(rng, raw, edits):
    """``raw`` with so many random edits inside its words."""
    text = bytearray(raw)
    for _ in range(edits):
        if len(text) < 3:
            break
        at, kind = rng.randrange(1, len(text) - 1), rng.randrange(3)
        if kind == 0:
            text[at : at + 1] = b""
        elif kind == 1:
            text[at : at + 1] = bytes([rng.choice(b"abcdefghij")])
        else:
            text[at:at] = bytes([rng.choice(b"abcdefghij")])
    return bytes(text)


def variants(notice):
    """(words before, name, words after, label) of a row of NOTICES."""
    before, names, after, _ = notice
    return [(before, "", "", names)] if isinstance(names, str) else [(before, n, after, label) for n, label in names.items()]


@pytest.mark.parametrize("seed", range(4))
def test_fuzzy_notices_are_found(seed):
    """Any notice with up to its number of edits outside the name is found, and its span holds it."""
    rng, ready = random.Random(seed), licenses.compiled()
    for notice in licenses.NOTICES:
        for before, name, after, label in variants(notice):
            for _ in range(6):
                k = rng.randint(0, notice[3])
                front = rng.randint(0, k) if before and after else k if before else 0
                text = b" ".join(x for x in (edited(rng, before.encode(), front), name.encode(), edited(rng, after.encode(), k - front)) if x)
                found = licenses.scan(b"some words before " + text + b" and after", ready)
                assert label in found["labels"].split(","), text
                assert any(n["label"] == label and n["first_word"] <= 3 + text.count(b" ") and n["end_word"] >= 4 and n["edits"] <= notice[3] for n in found["notices"]), text


def test_another_name_is_another_license():
    """Every known name in every frame has its own label and no other; an unknown one has none."""
    ready = licenses.compiled()
    for before, names, after, _ in licenses.NOTICES:
        if isinstance(names, dict) and len(names) > 1:
            frame = lambda name: " ".join(x for x in (before, name, after) if x).encode()  # noqa: B023, E731
            for name in licenses.NAMES:
                labels = licenses.scan(b"this is " + frame(name) + b" text", ready)["labels"]
                assert set(labels.split(",")) == {licenses.NAMES[name]}, name
            for name in ("wtf", "mut", "bds", "x", "cddl"):
                assert licenses.scan(frame(name), ready)["labels"] == ""
    for text in (b"some rights reserved", b"no rights reserved", b"gnu public library", b"the eu general public budget", b"the general public license"):
        assert licenses.scan(text, ready)["labels"] == ""
    for text, label in ((b"creatve commons attribution", "cc-by"), (b"mozila public license", "mpl"), (b"mit licence", "mit"), (b"apache licence version 2", "apache")):
        assert licenses.scan(b"under " + text + b" terms", ready)["labels"] == label


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def brute_places(w, notice):
    """(first word, end word, label) -> fewest edits, of all runs of words within the bound."""
    out, k = {}, notice[3]
    for before, name, after, label in variants(notice):
        for i in range(len(w)):
            for j in range(i + 1, len(w) + 1):
                if abs(len(" ".join(w[i:j])) - len(" ".join(x for x in (before, name, after) if x))) > k + 2:
                    continue
                if not name:
                    found = [distance(" ".join(w[i:j]), before)]
                else:
                    found = [distance(" ".join(w[i:p]), before) + distance(" ".join(w[p + 1 : j]), after) for p in range(i, j) if w[p] == name and (before or p == i) and (after or p == j - 1)]
                if (e := min(found, default=k + 1)) <= k:
                    out[i, j, label] = min(e, out.get((i, j, label), k))
    return out


def test_fuzzy_notices_match_brute_force():
    """Texts of edited notices and words, one notice at a time: every reported span is a place with its fewest edits, and every
    place is reported or overlaps a reported one with as few edits or fewer."""
    rng = random.Random(9)
    filler = "the license of this public text under any general terms source rights all gnu mit".split()
    n = 0
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            notice = rng.choice(licenses.NOTICES)
            before, name, after, _ = rng.choice(variants(notice))
            name = rng.choice([name, name, "xyz"]) if name else ""
            parts += [edited(rng, " ".join(x for x in (before, name, after) if x).encode(), rng.randint(0, notice[3] + 2)).decode(), " ".join(rng.choice(filler) for _ in range(rng.randint(0, 3)))]
        w = re.sub("[^a-z]+", " ", " ".join(parts)).split()
        starts = np.cumsum([0, *(len(x) + 1 for x in w)])
        flat = " ".join(w).encode()
        for notice in licenses.NOTICES:
            own = licenses.Notice(*notice)
            expected = {(int(starts[i]), int(starts[j]) - 1, label): e for (i, j, label), e in brute_places(w, notice).items()}
            n += len(expected)
            assert licenses.places(flat, own) == expected, (w, notice)
            found = licenses.matches(flat, own)
            assert all(expected[a, b, label] == e for a, b, e, label in found)
            for (a, b, _), e in expected.items():
                assert any(f <= e and x < b and a < y for x, y, f, _ in found)
            assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
    assert n > 100


def test_no_notice_is_lost_beside_another():
    rng, ready = random.Random(3), licenses.compiled()
    for _ in range(300):
        a, b = rng.sample(sorted(licenses.NAMES), 2)
        first = edited(rng, b"licensed under the", rng.randint(1, 3)) + f" {a} license".encode()
        found = licenses.scan(first + b" " + f"licensed under the {b} license".encode(), ready)
        assert {licenses.NAMES[a], licenses.NAMES[b]} <= set(found["labels"].split(",")), first
    assert len(licenses.scan(b"foo all right reserved and all rights reserved", ready)["notices"]) == 2
    assert licenses.scan(b"released under the mit licens released under the bsd license", ready)["labels"] == "bsd,mit"


def test_license_scan_is_fast_on_any_text():
    import time

    ready, rng = licenses.compiled(), random.Random(4)
    letters = lambda n: bytes(rng.choice(b"aeilcns ") for _ in range(n))
    texts = [b"licensed under the mit x " * 80_000, b"license " * 250_000, b"cc by " * 300_000, b"released under the mit license, " * 60_000, b"all rights gnu general public " * 60_000, b"mit " * 500_000, b"a" * 2_000_000]
    texts += [b"".join(head + letters(10) + b" " for _ in range(30_000)) for head in (b"licensed under the mit ", b"permission is hereby granted ")]
    for text in texts:
        began = time.perf_counter()
        found = licenses.scan(text, ready)
        assert time.perf_counter() - began < 4 * len(text) / 1e6 + 1, text[:40]
    assert licenses.scan(b"cc by " * 850_000, ready)["last_word"] == 1_699_998 and found["n_base"] == 0


# ---- 5


def brute_topk(rows, k=5, every=50):
    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = set()
    for q, vs in fine.items():
        if q % every == 0:
            scores = sorted((-max(sum(a * b for a, b in zip(vs[0], w, strict=True)) for w in ws), i) for i, ws in fine.items() if i != q)[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    return out


def test_topk_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [float(np.float32(rng.gauss(0, 1 + i % 3))) for _ in range(11)]) for i in range(300)]
    rows += [(300, None), (301, []), (350, [None] * 11), (400, [float("nan")] * 11), (450, [float("inf")] + [0.0] * 10), (None, [1.0] * 11), (500, rows[7][1]), (501, rows[7][1]), (502, rows[7][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    want = brute_topk(rows)
    for block in (4096, 3):
        got = {tuple(r) for r in topk.top_k(df, block=block).select("query_id", "rank", "vec_id", "score").collect()}
        assert got == want


def test_topk_few_rows_ties_and_empty(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0, 1.0]), (2, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0])], schema)
    assert [tuple(r) for r in topk.top_k(df).select("query_id", "rank", "vec_id", "score").orderBy("rank").collect()] == [(0, 1, 1, 65536), (0, 2, 2, 65536)]
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0


def test_topk_repeated_ids_take_one_place(spark):
    # id 3 is the nearest of all and stands in ten rows, and ids 0 (asked) and 4 in two rows that differ
    near = [(3, [9.0, 9.0])] * 10 + [(4, [1.0, 1.0]), (4, [5.0, 5.0]), (0, [1.0, 1.0]), (0, [-1.0, 1.0])]
    rows = near + [(k, [8.0 - k / 4, 1.0]) for k in range(5, 12)]
    score = {}
    for a, q in ((a, q) for a, q in rows if a % 50 == 0):
        for b, c in ((b, c) for b, c in rows if a != b):
            score[a, b] = max(score.get((a, b), -(10**12)), int(sum(256 * x * 256 * y for x, y in zip(q, c, strict=True))))
    want = [(n + 1, b, s) for n, (s, b) in enumerate(sorted(((s, b) for (_, b), s in score.items()), key=lambda x: (-x[0], x[1]))[:5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for parts in (1, 3, 7):
        got = topk.top_k(df.repartition(parts)).orderBy("rank").collect()
        assert [(r["rank"], r["vec_id"], r["score"]) for r in got] == want


def test_topk_computes_few_exact_products_on_clusters():
    rng = np.random.default_rng(5)
    centres = np.repeat(rng.normal(0, 200, (400, 16)), 4, axis=1) + rng.normal(0, 40, (400, 64))
    c = np.floor(centres[rng.integers(0, 400, 40_000)] + rng.normal(0, 8, (40_000, 64)))
    ids = rng.permutation(len(c))
    best = topk.Best(ids[:800], c[:800], 5)
    for at in range(0, len(c), 5000):
        best.add(ids[at : at + 5000], c[at : at + 5000])
    assert best.exact < 0.05 * best.pairs
    score = (c[:800] @ c.T).astype(int)
    score[np.arange(800), np.arange(800)] = topk.NONE
    for k in range(0, 800, 37):
        order = np.lexsort((ids, -score[k]))[:5]
        assert best.row[k].tolist() == ids[order].tolist() and best.score[k].tolist() == score[k][order].tolist()


def test_topk_blocks_are_sent_one_at_a_time(spark, monkeypatch):
    live, most, send = set(), [], spark.sparkContext.broadcast

    def sent(value):
        out = send(value)
        live.add(id(out))
        most.append(len(live))
        destroy = out.destroy
        out.destroy = lambda: (live.discard(id(out)), destroy())
        return out

    monkeypatch.setattr(spark.sparkContext, "broadcast", sent)
    rng = random.Random(8)
    rows = [(i, [float(np.float32(rng.gauss(0, 1))) for _ in range(6 + i % 2)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {tuple(r) for r in topk.top_k(df, every=7, block=2).select("query_id", "rank", "vec_id", "score").collect()}
    # vectors of two lengths: each query meets those of its own
    assert got == brute_topk(rows[::2], every=7) | {x for x in brute_topk([(i + 1000, v) for i, v in rows[1::2]], every=1) for x in [(x[0] - 1000, x[1], x[2] - 1000, x[3])] if x[0] % 7 == 0}
    assert len(most) > 3 and max(most) == 1 and not live


def test_topk_beyond_64_bits(spark):
    rows = [(0, [3e38, 3e38]), (1, [3e38, 1.0]), (2, [-3e38, 1.0]), (3, [1e9, 1e9]), (4, [1.0, 2.0]), (5, [2.0, 1.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 4, 5, 2] and got[0]["score"] == topk.LAST and got[-1]["score"] == topk.NONE + 1


def test_topk_bounds_hold():
    rng = np.random.default_rng(1)
    q, c = rng.integers(-300, 300, (40, 64)).astype(float), rng.integers(-300, 300, (60, 64)).astype(float)
    exact, last = q @ c.T, None
    for n in topk.LEVELS:
        bound = topk.statistics(q, n) @ topk.statistics(c, n).T
        assert (bound >= exact - 1e-6).all() and (last is None or (bound <= last + 1e-6).all())
        last = bound


# ---- 6


def splitmix64(z):
    z %= 2**64
    z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
    return z ^ z >> 31


def brute_fingerprint(text, family=0):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    if family:
        h = [splitmix64(x + family * 0x9E3779B97F4A7C15) for x in h]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    """``fps``: a fingerprint of each text, or one of each family."""
    fps = [f if isinstance(f, tuple) else (f,) for f in fps]
    parent = {i: i for i in range(len(ids))}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if any((x ^ y).bit_count() <= 3 for x, y in zip(fps[i], fps[j], strict=True)):
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(least.get(root(i), x), x)
    return [least[root(i)] for i in range(len(ids))]


def test_simhash_matches_brute_force(spark, small):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(50)]
    texts = [None, "", " \n", "One", "one TWO", "É\x1fx y"]
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(30, 400))]
        for _ in range(rng.randint(1, 9)):
            texts.append(" ".join(base))
            base[rng.randrange(len(base))] = rng.choice(words)
    texts += [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    fps = [brute_fingerprint(t) for t in texts]
    want = brute_components(list(range(len(texts))), fps)
    docs = documents(spark, texts).withColumn("fp", F.lit("clash")).withColumn("node", F.lit(1))
    for hot in (4096, 2):
        got = by_id(simhash.near_duplicates(docs, hot=hot))
        assert [got[k]["fingerprint"] for k in range(len(texts))] == [f"{x:016x}" for x in fps]
        assert [got[k]["component_id"] for k in range(len(texts))] == want


def test_covering_masks_cover():
    rng = random.Random(1)
    for level in simhash.mask_levels():
        masks = level[:15] if len(level) > 15 else level
        free = [b for b in range(64) if not any(m >> b & 1 for m in [])] if len(level) == 15 else None
        for _ in range(300):
            bits = rng.sample(free or range(64), rng.randint(0, 3)) if free else []
            diff = sum(1 << b for b in bits)
            if free:
                assert any(not m & diff for m in masks)
    # below a mask, any three of its free bits are all absent from one of the finer masks
    first, second = simhash.mask_levels()[:2]
    for k, m in enumerate(first):
        free = [b for b in range(64) if not m >> b & 1]
        for _ in range(100):
            diff = sum(1 << b for b in rng.sample(free, 3))
            assert any(not x & diff for x in second[15 * k : 15 * k + 15])


def test_simhash_chain_of_links(spark):
    fps = [(1 << 3 * k) - 1 for k in range(20)]  # each three bits from the next, far from the rest
    nodes = spark.createDataFrame([(simhash._signed(f), 100 + k) for k, f in enumerate(fps)], "fp long, node long")
    found = {r["node"]: r["component"] for r in components(simhash.links(nodes)).collect()}
    assert found == {100 + k: 100 for k in range(20)}


def test_simhash_repeated_rows_null_ids_and_empty(spark):
    docs = documents(spark, ["a b c d", "a b c d", "a b c d", "zz"], [5, 5, 3, None])
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == [(3, 3), (5, 3), (5, 3), (None, None)]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_simhash_links_by_text_not_by_id(spark):
    x, y, z = ("".join(random.Random(k).choices("abcdefgh  ", k=400)) for k in range(3))
    # one id with unrelated texts does not join their groups
    out = simhash.near_duplicates(documents(spark, [x, x, y, y], [1, 7, 7, 3])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in out) == [(1, 1), (3, 3), (7, 1), (7, 3)]


def test_simhash_chains_through_rows_without_id(spark, monkeypatch):
    fps = {"a": 0, "b": 0b111, "c": 0b111111, "d": (1 << 40) - 1 << 20}
    rows = [(5, fps["a"]), (None, fps["b"]), (9, fps["c"]), (None, fps["d"])]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame([(a, simhash._signed(b)) for a, b in rows], "doc_id long, fp long"))
    out = simhash.near_duplicates(documents(spark, ["x"])).collect()
    assert {(r["doc_id"], r["component_id"]) for r in out} == {(5, 5), (None, 5), (9, 5), (None, None)}


def test_distinct_rows_keep_each_text_of_an_id(spark):
    x, y, z = ("".join(random.Random(k).choices("abcdefgh  ", k=400)) for k in range(3))
    # y stands under two ids, of which one has x too; z only without an id; a null id with x goes
    rows = [(7, x), (7, y), (7, y), (9, y), (None, x), (None, z), (None, z)]
    df = documents(spark, [t for _, t in rows], [k for k, _ in rows])
    clashes = ["row", "_row", "doc", "fp", "component", "place", "node"]
    for c in clashes:
        df = df.withColumn(c, F.lit(c))
    for parts in (1, 4):
        out = neardup.distinct_rows(df.repartition(parts)).collect()
        assert all(r[c] == c for r in out for c in clashes) and list(out[0].asDict()) == df.columns
        assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out))) == sorted(map(str, [(7, x), (7, y), (None, z)]))


def near_copies(rng, groups=15):
    """Texts in groups of near copies, few of which one fingerprint alone links."""
    words, texts = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(300)], []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(60, 300))
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for at in rng.sample(range(len(base)), len(base) // rng.randint(40, 120)):
                copy[at] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


def similar_pairs(texts):
    """All pairs at a similarity of 0.8 or more."""
    sets = [neardup.shingles(lower(t).encode().split()) for t in texts]
    return [(i, j) for i in range(len(texts)) for j in range(i) if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and neardup.similarity(sets[i], sets[j]) >= 0.8]


def check_classes(spark, texts, recall, hot=4096):
    """No class joins what chains of similar pairs do not; the share of similar pairs in one class is ``recall`` at least."""
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r["row"]: r["component"] for r in neardup.classes(df, hot=hot).collect()}
    assert sorted(got) == list(range(len(texts))) and all(got[c] == c <= k for k, c in got.items())
    pairs, parent = similar_pairs(texts), list(range(len(texts)))
    for i, j in pairs:
        a, b = parent[i], parent[j]
        parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert all(parent[k] == parent[c] for k, c in got.items())
    assert pairs and sum(got[i] == got[j] for i, j in pairs) >= recall * len(pairs)
    return got


@pytest.mark.parametrize(("hot", "tile"), [(4096, 256), (3, 256), (4096, 5), (3, 5)])
def test_no_member_of_a_bucket_loses_its_partner(spark, hot, tile):
    """Texts share most of their words, so that one bucket holds many of them, and only one other of each is similar enough."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(2000)]
    common, texts = rng.choices(words, k=170), []
    for _ in range(60):
        own = rng.choices(words, k=34)
        texts += [" ".join(common + own), " ".join(common[3:] + own[:-5])]
    rng.shuffle(texts)
    made = [neardup.signature(t.encode()) for t in texts]
    proposed = [(i, j) for i, j in similar_pairs(texts) if (made[i][2] == made[j][2]).any() or (made[i][1] ^ made[j][1]).bit_count() <= 3]
    assert 50 < len(proposed) <= 60
    df = spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3)
    got = {r["row"]: r["component"] for r in (neardup.classes(df, hot=hot, tile=tile) if tile != 256 else neardup.classes(df, hot=hot)).collect()}
    assert [p for p in proposed if got[p[0]] != got[p[1]]] == []
    assert len(set(got.values())) == len(texts) - len(proposed)


@pytest.mark.parametrize("hot", [4096, 3])
def test_near_duplicates_are_those_of_all_pairs(spark, hot):
    texts = near_copies(random.Random(8), 40) + [None, "", " \n", "one two", "One  two", "one two three", "a b c d e", "A b c d e", "a b c d f"]
    got = check_classes(spark, texts, 0.97, hot)
    n = len(texts) - 9
    assert [got[n + k] for k in range(9)] == [n, n, n, n + 3, n + 3, n + 5, n + 6, n + 6, n + 8]
    # one row of each class stays, that of the smallest id
    kept = sorted(r["doc_id"] for r in neardup.distinct_rows(documents(spark, texts), hot=hot).collect())
    assert kept == sorted(set(got.values())) or len(kept) == len(set(got.values()))
    assert neardup.distinct_rows(documents(spark, [])).count() == 0


def test_near_duplicates_of_the_given_table(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    check_classes(spark, texts, 0.9)


def test_a_large_group_of_near_copies(spark):
    """Hundreds of near copies in common buckets, dealt into parts: still one class."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(200)]
    base, texts = rng.choices(words, k=150), []
    for _ in range(400):
        copy = list(base)
        copy[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(copy))
    assert len(set(check_classes(spark, texts, 0.99, 50).values())) == 1


def test_components_match_brute_force(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 360)] + [(400, k) for k in range(401, 470)]
    label = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: x for n, x in label.items() if n in got} and all(label[n] == n for n in label if n not in got)


# ---- 7


def test_rollup_matches_recount(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    counts = rollup.count_tokens(docs)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(lambda: [0, 0])
    gone = {r["doc_id"] for r in docs.where("doc_id % 3 = 0").collect()}
    for r in docs.collect():
        if r["doc_id"] in gone:
            continue
        text = r["text"]
        if r["doc_id"] % 2:
            text = "\n".join(dict.fromkeys(text.split("\n")))
        for name, n in ((rollup.version(public_tokenizers.path("word_bpe_49k.json")), len(tokenizer.encode(text, add_special_tokens=False).ids)), ("whitespace", len(text.encode().split()))):
            want[r["source"], r["lang"], name][0] += 1
            want[r["source"], r["lang"], name][1] += n
    kept = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    odd = counts.where("doc_id % 2 = 1")
    now = counts.where("doc_id % 3 = 0").withColumn("tokens", F.when(F.col("doc_id") % 2 == 1, F.col("revised_tokens")).otherwise(F.col("tokens")))
    assert kept.totals().count() == 0
    assert kept.commit("a", rollup.inserts(counts)) and kept.commit("b", rollup.revisions(odd)) and kept.commit("c", rollup.deletes(now))
    before = sorted(kept.totals().collect())
    assert not kept.commit("b", rollup.revisions(odd))  # a replay changes nothing
    assert sorted(kept.totals().collect()) == before
    assert {tuple(r)[:3]: list(r)[3:] for r in before} == dict(want)
    other = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    kept.compact(other)
    kept.compact(other)
    assert sorted(other.totals().collect()) == before and len(other.committed()) == 1


def test_rollup_nulls_empty_and_broken_batches(spark):
    docs = spark.createDataFrame([(1, None, None, None), (None, "a b\na b", "x", None)], "doc_id long, text string, lang string, source string").withColumn("tokens", F.lit("clash"))
    rows = {(r["lang"], r["tokenizer"]): (r["tokens"], r["revised_tokens"]) for r in rollup.count_tokens(docs).collect()}
    assert rows[None, "whitespace"] == (0, 0) and rows["x", "whitespace"] == (4, 2)
    kept = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    kept.commit("a", rollup.inserts(rollup.count_tokens(docs)))
    spark.createDataFrame([("s", "l", "t", 9, 9)], rollup.SCHEMA).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{kept.path}/batch=broken")
    assert kept.committed() == ["a"] and kept.totals().agg(F.sum("docs")).first()[0] == 4
    with pytest.raises(ValueError):
        kept.commit("../x", rollup.inserts(rollup.count_tokens(docs)))
    empty = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    empty.commit("none", rollup.inserts(rollup.count_tokens(documents(spark, []))))
    assert empty.totals().count() == 0


# ---- 8


def test_quality_on_held_out_labels(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    scorer = quality.fit(docs, labels.where("doc_id % 5 <> 0"))
    rows = quality.classify(docs.join(labels.where("doc_id % 5 = 0"), "doc_id"), scorer).select("quality", "toxic", "keep").collect()
    clean = [r["keep"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["keep"] for r in rows if r["quality"] == 0]
    toxic = [r["keep"] for r in rows if r["toxic"] == 1]
    assert len(clean) > 300 and sum(clean) / len(clean) > 0.99
    assert sum(junk) / len(junk) < 0.05 and sum(toxic) / len(toxic) < 0.15


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(3)
    bad = rng.random(20_000) < 0.3
    votes = np.stack([np.where(rng.random(len(bad)) < 0.3, -1, np.where(rng.random(len(bad)) < a, bad, ~bad)) for a in (0.95, 0.9, 0.7, 0.85)], axis=1).astype(int)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.LabelModel(patterns, counts.astype(float))
    for k, accuracy in enumerate((0.95, 0.9, 0.7, 0.85)):
        assert abs(model.table[k, 1, 2] - accuracy) < 0.04 and abs(model.table[k, 0, 1] - accuracy) < 0.04
    assert ((model.posterior(votes) > 0.5) == bad).mean() > 0.93


def test_label_model_posteriors_are_those_of_enumeration():
    """Bayes by hand over both classes, and a step of expectation-maximisation that changes nothing."""
    patterns = np.array([[1, 1, -1], [1, 0, 1], [0, 0, 0], [-1, -1, -1], [0, -1, 1], [-1, 0, -1]])
    counts = np.array([30.0, 5, 200, 40, 3, 60])
    trust = [quality.HEURISTIC, quality.HEURISTIC, quality.LABEL]
    model = quality.LabelModel(patterns, counts, trust, rounds=3000)
    found = model.posterior(patterns)
    for row, p in zip(patterns, found, strict=True):
        joint = [1 - model.prior, model.prior]
        for k, v in enumerate(row):
            for c in (0, 1):
                joint[c] *= model.table[k, c, v + 1] if v >= 0 else 1
        assert abs(joint[1] / sum(joint) - p) < 1e-9
    assert abs(found[3] - model.prior) < 1e-9 and abs(model.told(found)[3]) < 1e-9  # who votes nothing tells nothing
    assert abs(model.prior - (found @ counts + 1) / (counts.sum() + 2)) < 1e-6
    for k, (accuracy, share) in enumerate(trust):
        for c in (0, 1):
            weight = (found if c else 1 - found) * counts
            votes, bad = weight[patterns[:, k] >= 0].sum(), weight[patterns[:, k] == 1].sum()
            beside = 1 + share * votes
            assert abs(model.table[k, c, 2] - (bad + beside * (accuracy if c else 1 - accuracy)) / (votes + beside)) < 1e-6


def test_quality_targets_are_posteriors(spark, monkeypatch):
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    taught = []
    monkeypatch.setattr(quality, "train", lambda rows, target, weight: taught.append((target, weight)) or (np.zeros(0, np.int64), np.zeros(0), 0.0))
    models = quality.fit(docs, labels).models
    known = {r["doc_id"]: (1 - r["quality"], r["toxic"]) for r in labels.collect()}
    texts = {r["text"]: r["doc_id"] for r in docs.orderBy(F.desc("doc_id")).collect()}
    for h, (head, (target, weight)) in enumerate(zip(quality.HEADS, taught, strict=True)):
        assert len(target) > 300 and 0 < weight.min() and weight.max() <= 1
        possible = set()
        for text, k in texts.items():
            raw = (text or "").encode()
            v = quality.votes(quality.shape(raw), set(raw.translate(quality.WORDS).split()))[head]
            possible |= {round(float(models[head].posterior(np.array([[*v, label]]))[0]), 9) for label in {known.get(k, (-1, -1))[h], -1}}
        assert {round(float(x), 9) for x in target} <= possible


def test_quality_bears_wrong_labels(spark):
    """A fifth of the labels turned round: junk still goes and clean documents stay."""
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    turned = labels.withColumns({c: F.when(F.pmod(F.xxhash64("doc_id", F.lit(c)), F.lit(5)) == 0, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    found = quality.classify(docs.join(labels, "doc_id"), quality.fit(docs, turned)).groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {(r["quality"], r["toxic"]): r["kept"] for r in found}
    assert kept[1, 0] > 0.97 and kept[0, 0] < 0.05 and kept[1, 1] < 0.6


def test_quality_without_labels_and_odd_tables(spark, odd):
    empty = documents(spark, [])
    assert quality.classify(empty, quality.fit(empty)).count() == 0
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 0, 1), (2, 1, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    for given in (None, labels):
        out = quality.classify(odd, quality.fit(odd, given))
        assert out.count() == odd.count() and dict(out.dtypes)["keep"] == "boolean" and dict(out.dtypes)["h"] == "int"
    assert quality.classify(odd.union(odd), quality.fit(odd)).count() == 2 * odd.count()


# ---- 9


def check_packing(pieces, texts, capacity=4096):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p["doc_id"]].append(p)
        sequences[p["sequence_id"]].append(p)
    assert set(docs) == set(texts)
    for k, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(docs[k], key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    padding = 0
    for ps in sequences.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding


def test_packing_round_trip(spark, odd, small):
    for docs in (odd, spark.read.parquet(f"{small}/documents.parquet").repartition(3)):
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert check_packing(packing.pack(docs).collect(), texts) == 0
        assert check_packing(packing.pack(docs, block=2).collect(), texts) == 0
    assert packing.pack(documents(spark, [])).count() == 0


def test_packing_repeated_rows_and_null_ids(spark):
    rows = packing.pack(documents(spark, ["a b", "a b", "a"], [1, 1, None])).collect()
    assert sum(r["length"] for r in rows) == 3 + 3 + 2


def test_packing_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randint(20, 1500) for _ in range(3000)]
    n = sum(lengths) // 4096
    placed, left = packing.place(lengths, n, 4096, 1.0, 1 / 4096)
    assert all(sum(x[2] for x in s) == 4096 for s in placed)
    assert sum(x[2] for s in placed for x in s) + sum(lengths[k] - a for k, a in left) == sum(lengths)
    cost = [sum(x[2] + x[2] ** 2 / 4096 for x in s) for s in placed]
    mixed = [lengths[k : k + 8] for k in range(0, len(lengths), 8)]
    random_cost = [sum(x + x**2 / 4096 for x in s) / sum(s) * 4096 for s in mixed]
    assert np.std(cost) < 0.5 * np.std(random_cost)
    cut = sum(len(s) for s in placed) + len(left) - len(lengths)
    assert cut < 0.2 * len(lengths)


def test_packing_takes_the_cheapest_sequence_with_room():
    rng = random.Random(4)
    for _ in range(60):
        sequences, capacity = rng.randint(1, 90), 64
        lengths = [rng.choice((1, 2, 31, 33, 40, 63, 64)) for _ in range(sequences)]
        while sum(lengths) < sequences * capacity:
            lengths.append(rng.randint(1, 64))
        placed, left = packing.place(lengths, sequences, capacity, 1.0, 0.25)
        room, cost, whole = [capacity] * sequences, [0.0] * sequences, {}
        for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
            n = lengths[item]
            fits = [s for s in range(sequences) if room[s] >= n]
            if fits:
                s = min(fits, key=lambda s: (cost[s], s))
                whole[item] = s
                room[s] -= n
                cost[s] += n + 0.25 * n * n
        assert {k: s for s, pieces in enumerate(placed) for k, a, n in pieces if a == 0 and n == lengths[k] and k in whole} == whole
        assert all(sum(x[2] for x in pieces) == capacity for pieces in placed)
        assert sum(lengths[k] - a for k, a in left) == sum(lengths) - sequences * capacity


def test_special_tokens_are_those_of_the_loaded_file(spark):
    texts = ["<|endoftext|>", "one <|startoftext|>two<|endoftext|>.", "ONE <|ENDOFTEXT|>"]
    assert check_packing(packing.pack(documents(spark, texts)).collect(), dict(enumerate(texts))) == 0


# ---- 10


def brute_decontaminate(text, items):
    w = WORD.findall(lower(text))
    hit, names = set(), set()
    for name, item in items:
        iw = WORD.findall(lower(item))
        for k in range(max(1, len(iw) - 12) if iw else 0):
            p = iw[k : k + 13]
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit |= set(range(i, i + len(p)))
                    names.add(name)
    return len(w), len(hit), sorted(names), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(30)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, sentence(rng.randint(0, 40))) for k in range(20)] + [(20, "W1"), (21, "w2 w3"), (22, None), (23, ""), (None, sentence(20)), (4, sentence(15))]
    texts = [None, "", "w1", "W2, w3"] + [sentence(rng.randint(0, 200)) for _ in range(20)]
    for _ in range(40):
        parts = [sentence(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            x = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(x) - 5))
            parts += [" ".join(x[a : a + rng.randint(5, 40)]).upper(), sentence(rng.randint(0, 300))]
        texts.append(" -- ".join(parts))
    docs = documents(spark, texts).withColumn("n_hit", F.lit("clash"))
    clashes = ["_hits", "_names", "_text", "_n", "hits", "names", "n", "doc", "row"]
    for c in clashes:
        docs = docs.withColumn(c, F.lit(c))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(7))
    named = [("null" if k is None else str(k), t) for k, t in items]
    want = [brute_decontaminate(t, named) for t in texts]
    for block in (4_000_000, 300):
        out = decontaminate.decontaminate(docs, bench, block_chars=block)
        assert out.columns == [*[c for c in docs.columns if c != "n_hit"], *decontaminate.RESULT] and out.where(" and ".join(f"{c} = '{c}'" for c in clashes)).count() == len(texts)
        got = by_id(out)
        assert [(got[k]["n_words"], got[k]["n_hit"], got[k]["item_names"], got[k]["contaminated"]) for k in range(len(texts))] == want


def test_decontamination_odd_tables(spark, odd):
    bench = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.decontaminate(odd, bench)
    assert out.count() == odd.count() and out.where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.decontaminate(documents(spark, []), bench).count() == 0
    # sha of no names is that of the empty string
    assert decontaminate.digest([]) == SHA_EMPTY


def test_cached_ids_are_those_of_the_tokenizer():
    from rallylake.llm.tokens import ChunkEncoder

    rng = random.Random(8)
    pieces = ["it's", "IT'S.", "don't!!", "a.b", "x=", "̸", "≠", "é", "é.", "É,", "ß!", "Σ", "ΑΣ.", " ", "\xa0", "\x1c", "\x01", "<|endoftext|>", "12.5%", "''", "'", "'.", "a'", "a'.", "…!", "!…", "‍", "日本語", "日本語.", "ﬁ", "K", "İ.", "🏸.", "\x00."]
    texts = ["".join(rng.choice([*pieces, " ", "\n", "\t ", "\x0b", "w", "Word,"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    special = ["<|endoftext|>", "<|startoftext|>", "a<|endoftext|>b", "x<|endoftext|>.", "<|ENDOFTEXT|>", "<|EndOfText|>!", "<|endoftext|"]
    texts += ["".join(rng.choice([*special, *pieces[:6], " ", "\n"]) for _ in range(rng.randint(0, 20))) for _ in range(300)] + special
    encoder, fresh = ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), cache=900), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        want = [x.ids for x in fresh.encode_batch(part, add_special_tokens=False)]
        column = pa.array([None, *part, ""], pa.string())
        assert [x.tolist() for x in encoder.encode(column)] == [[], *want, []]
        assert encoder.lengths(column[1:]).tolist() == [*map(len, want), 0]
    assert encoder.encode(pa.array([], pa.string())) == []
