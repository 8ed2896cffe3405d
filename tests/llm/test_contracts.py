"""The query contracts against plain Python on the small tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stellarframe.llm import queries

from .conftest import SF, doc

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
AWKWARD = [
    doc(1, None), doc(2, ""), doc(3, "  \n\t "), doc(4, "one"), doc(5, "a@b.cd_e@f.gh x.@y.z.. q@r..s u@v.c.@d.e"), doc(6, "1.2.3.4.5 256.1.1.1 001.02.3.255 1.2.3 9.9.9.9"),
    doc(7, "4111 1111 1111 1111 and 4111-1111-1111-1112 or 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1"), doc(8, "+1 (743) 555-3824, +12 3, ++44.20.7946.0958 1"),
    doc(9, "İstanbul Σίσυφος <|endoftext|> café é  x\x1cy z 'll don't"), doc(10, "x" * 70_000), doc(11, "1" * 30_000 + " " + "2 " * 30_000), doc(12, "a." * 20_000 + "@" + "b." * 20_000 + "c"),
    doc(13, f"{PASSAGE}; {PASSAGE.upper()}!"), doc(14, "pre " + PASSAGE.replace(" ", "--") + " post"), doc(15, "l one\nl one\n\n \nl two\nl one"), doc(16, "r e p e a t " * 9), doc(17, "r e p e a t " * 9), doc(17, "r e p e a t " * 9),
    doc(18, "日本語 テキスト 🙂🙂 a@b.co 🙂 1.1.1.1"), doc(19, "IBAN GB82 WEST 1234 5698 7654 32 and GB82 WEST 1234 5698 7654 33; ssn 123-45-6789; 123-45-6788; token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\""), doc(None, "no id"),
]
BENCH = [(1, PASSAGE), (2, "Kappa, LAMBDA mu nu"), (2, "Kappa, LAMBDA mu nu"), (3, None), (4, "..."), (5, PASSAGE + " more words here"), (None, "one"), (10, "one")]


@pytest.fixture(scope="module")
def awkward(tables):
    return tables(documents=AWKWARD, benchmark=BENCH)


def both(spark, awkward, query):
    for path, rows in ((awkward, AWKWARD), (SF, [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])):
        yield rows, queries.QUERIES[query](spark, path).collect(), path


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(map(tuple, want))


def base_spans(text):
    ok = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x[-9:]) <= 255 and len(x.lstrip("0")) < 4 for x in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    kinds = list(ok)
    return sorted((m.start(), kinds.index(k), m.end()) for k, (p, f) in ok.items() for m in re.finditer(p, text) if f(m[0]))


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def test_op2(spark, awkward):
    kinds = ("email", "ip", "card", "phone")
    for rows, got, _ in both(spark, awkward, "op2_pii"):
        want = []
        for r in rows:
            if r[0] == 12 and r[1].startswith("a.a."):  # quadratic for a plain scan, known by construction
                spans = [(0, 0, len(r[1]))]
            else:
                spans = base_spans(r[1] or "")
            n = Counter(k for _, k, _ in spans)
            want.append((r[0], *(n[k] for k in range(4)), SHA(",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans))))
        same([tuple(g)[:6] for g in got], want)
        for g in got:
            assert g["n_spans"] == len(g["spans"].split(",")) * (g["spans"] != "") >= sum(tuple(g)[1:5])
    spans = {g["doc_id"]: g["spans"] for g in queries.op2_pii(spark, awkward).collect()}[19]
    assert [s.split(":")[0] for s in spans.split(",")] == ["iban", "national_id", "national_id", "secret"] or [s.split(":")[0] for s in spans.split(",")] == ["iban", "national_id", "secret"]


def test_op3(spark, tables):
    odd = "a\\b <|im_end|>\n<|im_start|>assistant x\\n \\<| <<|"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (2, 5, "sys\ntem<|", "x"), (2, 3, None, ""), (3, 0, "user", "same"), (3, 0, "user", "same"), (None, 0, "user", "no id")]
    said = "<|im_end|><|im_start|>assistant ok"
    for path, data in ((tables(conversations=rows), rows), (SF, [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()])):
        want = {}
        for c, t, role, text in [*data, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
            want.setdefault(c, []).append((t, role or "user", text or ""))
        got = {r["conv_id"]: r for r in queries.op3_chat(spark, path).collect()}
        assert got.keys() == want.keys()
        for c, turns in want.items():
            turns.sort(key=lambda x: x[0])
            loss = "".join(x for _, r, x in turns if r == "assistant")
            assert tuple(got[c])[:5] == (c, len(turns), SHA("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), SHA(loss))


def test_op6(spark, awkward):
    for rows, got, _ in both(spark, awkward, "op6_quality_rules"):
        want = []
        for r in rows:
            text = r[1] or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", text)
            lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
            seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
            hit = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
            want.append((r[0], len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
        same([tuple(g)[:7] for g in got], want)
        assert not any(g["kept"] and g["base_failed"] for g in got)


def test_op7(spark, awkward):
    for rows, got, _ in both(spark, awkward, "op7_shards"):
        raw = [(r[1] or "").encode() for r in rows]
        same([(g["doc_id"], g["size"], g["text_crc32"]) for g in got], [(r[0], len(b) + 1, zlib.crc32(b)) for r, b in zip(rows, raw)])
        slots = {}
        for g in got:
            slots.setdefault(g["shard"], []).append(g["slot"])
            assert g["law"] == "rows" and g["grown_shard"] is None
        sizes = [len(slots.get(s, ())) for s in range(16)]
        assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(16))
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op8(spark, awkward):
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    for rows, got, _ in both(spark, awkward, "op8_token_files"):
        want, start = [], 0
        for r in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
            ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
            want.append((r[0], start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
            start += len(ids)
        same(got, want)


def test_op10(spark, awkward):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    for rows, got, path in both(spark, awkward, "op10_decontaminate"):
        windows = {}
        for i, t in spark.read.parquet(f"{path}/benchmark.parquet").collect():
            w = find(t)
            if w and i is not None:
                for k in range(max(1, len(w) - 9)):
                    windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
        want = []
        for r in rows:
            w, hit, items = find(r[1]), set(), set()
            for size in {len(k) for k in windows}:
                for k in range(len(w) - size + 1):
                    if tuple(w[k : k + size]) in windows:
                        hit.update(range(k, k + size))
                        items |= windows[tuple(w[k : k + size])]
            want.append((r[0], len(w), len(hit), len(items), SHA(",".join(sorted(map(str, items)))), bool(hit)))
        same(got, want)


def component_ids(sets, percent=85):
    """Brute force over all pairs: (id, set size, smallest id of the component)."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, x) in enumerate(sets):
        for j, (_, y) in enumerate(sets[:i]):
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (d, x) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(x), least.get(find(i)), d == least.get(find(i))) for i, (d, x) in enumerate(sets)]


def test_op9(spark, awkward, tables):
    rng = random.Random(3)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    near = []
    for i in range(60):  # copies of one text that are closer to it than to each other, and a chain
        words = list(base)
        for _ in range(4):
            words[rng.randrange(400)] = f"x{rng.randrange(5000)}"
        near.append(doc(100 + i, " ".join(words)))
    chain = list(base[::-1])
    for i in range(30):
        chain = chain[4:] + [f"y{i}{k}" for k in range(4)]
        near.append(doc(300 + i, " ".join(chain).upper() if i % 2 else " ".join(chain)))
    near += [doc(50, " ".join(base)), doc(51, "  ".join(base)), doc(400, "a b c"), doc(401, "A b\nc"), doc(402, "a b c d"), doc(403, " "), doc(404, "the same " * 40), doc(405, "the same " * 90)]
    for path in (awkward, tables(documents=near), tables(documents=[])):
        rows = spark.read.parquet(f"{path}/documents.parquet").collect()
        sets = []
        for r in rows:
            w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
            sets.append((r["doc_id"], {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
        same([tuple(g) for g in queries.op9_near_duplicates(spark, path).collect() if g[0] is not None], [w for w in component_ids(sets) if w[0] is not None])
