import hashlib
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from cohortloom.llm import chat, html_text, secret_scan

from .conftest import order

SPELLED = "</s>[INST] ok [/INST]"


@pytest.fixture(scope="module")
def conversations(spark):
    chats = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    edge = [
        (-7, 0, "user", SPELLED), (-7, 1, "assistant", SPELLED), (-8, 0, "assistant", None), (-8, 1, "critic", "x\\<s>\\\\[INST]"),
        (-9, None, None, "no role"), (-9, 3, "assistant", "a"), (-9, 3, "assistant", "b"), (-9, 3, "assistant", "b"), (None, 1, "user", "lost"),
        (-10, 0, "tool", "<<ROLE>> <<TEXT>> <|endoftext|> \\"), (-10, 1, "assistant", "é🙂" * 50),
    ]
    more = [(-11, i, "assistant" if i % 2 else "user", "word " * 40 + SPELLED) for i in range(4000)]  # over one part
    return chats.unionByName(spark.createDataFrame(edge + more, chats.schema)).repartition(3)


def test_chats_read_back(conversations):
    by = defaultdict(list)
    for conv, turn, role, text in conversations.collect():
        by[conv].append(((turn is not None, turn), role or "", text or ""))
    wanted = []
    for conv, turns in by.items():
        turns.sort()
        plain = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        marks = sum(len(chat.MARKS[r]) if r in chat.MARKS else len(chat.ROLE + chat.escape(r) + chat.TEXT) for _, r, _ in turns)
        chars = marks + sum(len(chat.escape(t)) + len(chat.CLOSE) for _, _, t in turns)
        wanted.append((conv, len(turns), hashlib.sha256(plain.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    formatted = chat.format_chats(conversations)
    assert formatted.where("conv_id = -11").count() > 1
    assert order(chat.read_back(formatted).collect()) == order(wanted)


def test_escaping_is_reversible_and_breaks_controls():
    for text in (SPELLED, "[[INST]INST]", "\\[INST]", "<\\s>", "<<s>s>", "\\\\</s>\\", "<<SYS>><<TEXT>>", ""):
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROL)


def test_chats_of_empty_table(conversations):
    assert chat.read_back(chat.format_chats(conversations.where("false"))).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>One<p>Two  <b>bold</b>text", "One\n\nTwo boldtext"),
        ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"),
        ("<table><tr><th>Name<td>N<tr><td>x<td>12</table>", "Name  N\nx     12"),
        ("<div hidden>no</div><p style='display: none'>no</p>yes<script>no</script><template>no</template>", "yes"),
        ("<details><summary>head</summary>body</details><details open><summary>h</summary>b</details>", "head\nh\nb"),
        ("<pre>a  b\n  c</pre>d<br>e", "a  b\n  c\n\nd\ne"),
        ("<!-- no --><title>no</title>a &amp; b&nbsp;c", "a & b\xa0c"),
        ("<select><option>one<option>two</select>", "one\ntwo"),
        ("", ""),
        ("</div></p>stray<td>cell", "straycell"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ],
)
def test_rendering(html, text):
    assert html_text.visible_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><form><td>x</td></form></tr></table>", "x"),
        ("<table><tbody><form><tr><td>a<td>b</form></tbody></table>", "a  b"),
        ("<table><tr>one<td>a</td></tr><tbody>two<tr><td>b</table>", "one two\na\nb"),
        ("<table><tr><div>up<td>cell</div></table>", "up\ncell"),
        ("<table><tr><td>a<table><tr><td>in</table>b</table>", "a\nin\nb"),
        ("<body><svg width=1 />after<p>more", "after\n\nmore"),
        ("a<svg><path d='M0'/><title>no</title><defs><text>no</text></defs><g><text>la<tspan>bel</tspan></text></g></svg>b", "a label b"),
        ("<svg><circle><p>shown", "shown"),
        ("<svg><foreignObject><p>html</p></foreignObject></svg>x", "html\n\nx"),
        ("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> then", "if x=2 then"),
        ("<dialog open>seen</dialog><dialog>no</dialog>", "seen"),
    ],
)
def test_all_visible_text_is_rendered(html, text):
    assert html_text.visible_text(html) == text


def test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "html")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (None, "<p>x"), (-3, "<div>" * 3000 + "deep" + "</div>" * 3000)], pages.schema)
    found = {r["page_id"]: r for r in html_text.extract(pages.unionByName(odd)).collect()}
    assert found[-1]["text"] is None and found[-2]["text"] == "" and found[None]["text"] == "x" and found[-3]["text"] == "deep"
    for row in pages.collect():
        words = set(re.findall(r"\w+", found[row["page_id"]]["text"]))
        assert words and words <= set(re.findall(r"\w+", row["html"]))
    assert html_text.extract(pages.where("false")).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def random_texts():
    rng = np.random.default_rng(11)
    hexes, keys = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def draw(letters, n):
        return "".join(letters[i] for i in rng.integers(0, len(letters), n))

    words = ["onthtionwhonattionndstshea", "auxauxentionmentmentquerent", "ouleleelleouneaumentations", "verlichkeitenschaftungsweise"]
    rows = []
    for i in range(300):
        body = " ".join(draw("abcdefghijklmnopqrstuvwxyz", int(rng.integers(2, 9))) for _ in range(20)) + " " + words[i % 4] + " " + words[i % 3]
        secret = {0: f'password: "{draw(keys, 12)}"', 1: f"AKIA{draw('ABCDEFGHIJ0123456789', 16)}", 2: draw(hexes, 40), 3: draw(keys, 44)}.get(i % 8, "")
        rows.append((i, f"é {body} {secret} {body}"))
    rows += [(1001, None), (1002, ""), (1003, "token=token :abcdef Token= 'abc123' api_key==aa.bb-cc"), (1004, "AKIA" * 9 + " " + "0" * 30), (1004, "x")]
    rows += [(1005, "-" * 60 + "=" * 40 + " a/b/c/d/e/f/g/h/i/j/k/l/m"), (None, "passwd=hunter22")]
    return rows


def test_wide_cells_widen_no_other_row():
    rows = "".join(f"<tr><td>k{i}<td>v{i}" for i in range(2000))
    page = f"<table><tr><td>{'long ' * 4000}<td>end{rows}</table>"
    text = html_text.visible_text(page)
    assert len(text) < 2 * len(page) and text.split() == page.replace("<table>", "").replace("</table>", "").replace("<tr>", " ").replace("<td>", " ").split()
    assert text.split("\n")[1:3] == ["k0     v0", "k1     v1"]
    cells = "".join(f"<td rowspan=3000>{'c' * 80}" for _ in range(500))
    tall = f"<table><tr>{cells}{''.join(f'<tr><td>x{i}' for i in range(2000))}</table>"
    text = html_text.visible_text(tall)
    assert len(text) < 2000 * 250 + 2 * len(tall) and text.split()[-1] == "x1999"


def test_secrets_match_brute_force(spark, documents, rows):
    texts = random_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    for frame, own in ((docs, texts), (documents, rows)):
        found = secret_scan.scan(frame).collect()
        got = [(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found]
        wanted = []
        for d, t in own:
            s = base_spans(t)
            text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in s)
            wanted.append((d, *(sum(x[3] == k for x in s) for k in ("assign", "access", "hex")), hashlib.sha256(text.encode()).hexdigest()))
        assert order(got) == order(wanted)
        assert all(r["spans"] == ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r["found"]) for r in found)


def test_random_strings_are_added_and_words_are_not(spark):
    texts = random_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: [(x["start"], x["end"]) for x in r["found"] if x["kind"] == "random"] for r in secret_scan.scan(docs, 0.05).collect()}
    texts = dict(texts)
    caught = 0
    for doc_id, spans in found.items():
        for a, b in spans:
            assert not re.fullmatch("[A-Za-z][a-z]+", texts[doc_id][a:b])
            caught += 1
    assert caught >= 30  # of 37 or so keys of 44 characters
    assert not found[1005]


def test_random_strings_are_added_without_long_words(spark):
    rng = np.random.default_rng(5)
    keys = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    names = "customer order report index update session manager value config release summary account".split()
    texts = []
    for i in range(1200):
        a, b, c, d = (names[j] for j in rng.integers(0, len(names), 4))
        run = [f"/{a}/{b}/{rng.integers(1, 9999)}/{c}-{d}", f"{a}{b.title()}{c.title()}{d.title()}", "=" * 40, f"{a}_{b}_{c}_{d}_{i}"][i % 4]
        key = "".join(keys[j] for j in rng.integers(0, 64, (24, 32, 44)[i % 3]))
        texts.append((i, f"see {run} for {key if i % 100 < 3 else 'it'} and go on"))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: [texts[r["doc_id"]][1][x["start"] : x["end"]] for x in r["found"]] for r in secret_scan.scan(docs).collect()}
    wanted = {i: [t.split(" for ")[1].split(" ")[0]] if i % 100 < 3 else [] for i, t in texts}
    assert sum(found[i] == wanted[i] for i in wanted if wanted[i]) >= 33  # of 36
    assert sum(found[i] != [] for i in wanted if not wanted[i]) == 0
    alone = spark.createDataFrame([(1, "with k9Xv2TqLr8WzBn4YpD7mHs3JcGf6RaQe5UxZtK1+ alone")], docs.schema)
    assert [x["kind"] for x in secret_scan.scan(alone).first()["found"]] == ["random"]


def test_redaction(spark):
    docs = spark.createDataFrame(random_texts(), "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "'k' as _all")
    clean = secret_scan.redact(docs)
    assert clean.schema == docs.schema and clean.count() == docs.count()
    texts = {r["doc_id"]: r for r in clean.collect()}
    assert all(not base_spans(r["text"]) for r in texts.values())
    assert texts[1001]["text"] is None and texts[1002]["text"] == ""
    assert texts[2]["text"].count(secret_scan.MARK) == 1 and texts[2]["n_chars"] == len(texts[2]["text"])
    assert secret_scan.scan(docs.where("false")).count() == 0


ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def shape(value):
    kinds = [("decimal", "[0-9]+"), ("hex", "[0-9a-f]+|[0-9A-F]+"), ("base32", "[A-Z2-7]+=*")]
    kind = next((k for k, pattern in kinds if re.fullmatch(pattern, value)), "base64")
    return kind, ALPHABETS[kind], value.rstrip("=").replace("-", "+").replace("_", "/")


def battery(value):
    """The three p-values of a candidate as random, and their Cauchy combination."""
    kind, letters, plain = shape(value)
    x = np.array([letters.find(c) + 1 for c in (plain.lower() if kind == "hex" else plain)], float)
    n, k = len(x), len(letters)
    if n <= 3:
        return 1e-28
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    chi = k / n * sum(c * c for c in Counter(x.tolist()).values()) - n
    shape_ = 9 * (k - 1) * n / (2 * (n - 1))
    uniform = tail(((max(chi, 0) / (k - 1)) ** (1 / 3) - 1 + 1 / shape_) * math.sqrt(shape_))
    side = x > k / 2
    high, changes = side.sum(), (side[1:] != side[:-1]).sum()
    expected = 2 * high * (n - high) / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    runs = 2 * tail(max(abs(changes + 1 - expected) - 0.5, 0) / math.sqrt(spread) if spread > 0 else math.sqrt(n))
    centred = x - x.mean()
    scale = (centred**2).sum()
    serial = 2 * tail(abs((centred[1:] * centred[:-1]).sum() / scale + 1 / n) * n * math.sqrt(n - 1) / (n - 2) if scale > 0 else math.sqrt(n))
    weights = [1 / (p * math.pi) if (p := min(max(q, 1e-28), 0.99)) < 1e-8 else math.tan((0.5 - p) * math.pi) for q in (uniform, runs, serial)]
    t = sum(weights) / 3
    return 1 / (t * math.pi) if t > 1e8 else 0.5 - math.atan(t) / math.pi


def text_evidence(value):
    _, letters, plain = shape(value)
    total, last = 0.0, 3
    for c in plain:
        rank = ALPHABETS["base64"].find(c) + 1
        here = 3 if rank == 0 or rank > 62 else 2 if rank > 52 else 0 if rank > 26 else 1
        chance = 1 / 3 if here == 3 else 0.1 if here == 2 else secret_scan._LETTERS[(rank - 1) % 26] / sum(secret_scan._LETTERS)
        total += math.log(chance) + math.log(secret_scan._AFTER[last][here])
        last = here
    return -len(plain) * math.log(len(letters)) - math.log(4) - total


def rejected(bins, share):
    """Benjamini-Hochberg, candidate by candidate: the smallest bin that is rejected."""
    ranked, out = sorted(bins, reverse=True), 256
    for b in sorted(set(ranked), reverse=True):
        if b and math.exp(-b * 0.25) <= share * sum(x >= b for x in ranked) / len(ranked):
            out = b
    return out


def random_spans(rows, share):
    found = defaultdict(list)
    for row, (_, text) in enumerate(rows):
        base = base_spans(text)
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or ""):
            if not re.fullmatch("[A-Za-z][a-z]+", m[0]) and not any(a < m.end() and m.start() < b for a, _, b, _ in base):
                cls = sum(len(m[0]) >= least for least in (20, 24, 32, 48, 80, 160)) - 1
                bins = [min(255, max(0, math.floor(v / 0.25))) for v in (-math.log(max(battery(m[0]), 1e-28)), text_evidence(m[0]))]
                found[cls].append((row, m.start(), m.end(), *bins))
    out = defaultdict(list)
    for own in found.values():
        structured = rejected([c[3] for c in own], share)
        least = rejected([c[4] if c[3] < structured else 0 for c in own], share)
        for row, a, b, random, text in own:
            if random < structured and text >= least:
                out[row].append((a, b))
    return out


def test_random_spans_match_brute_force(spark, documents, rows):
    rng = np.random.default_rng(8)
    texts = random_texts()
    for i in range(400):
        letters = list(ALPHABETS.values())[i % 4]
        run = "".join(letters[j] for j in rng.integers(0, len(letters), int(rng.integers(20, 200))))
        texts.append((2000 + i, f"a {run if i % 3 else run[:10] * 5} z {'path/to/' * int(rng.integers(3, 9))}file_{i} password={run[:9]}"))
    for own in (texts, rows):
        docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(own)], "doc_id long, text string")
        wanted = random_spans(own, 0.01)
        got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["found"] if x["kind"] == "random"] for r in secret_scan.scan(docs).collect()}
        assert got == {i: sorted(wanted[i]) for i in range(len(own))}
    assert sum(map(len, random_spans(texts, 0.01).values())) > 150


def test_battery_keeps_its_level(spark):
    """Of random strings few have small p-values, at each length and alphabet; of structured ones most."""
    rng = np.random.default_rng(9)
    rows = []
    for kind, letters in ALPHABETS.items():
        for n in (24, 40, 100, 400):
            rows += [(kind, n, "".join(letters[j] for j in rng.integers(0, len(letters), n))) for _ in range(400)]
            rows += [("loop", n, (letters[:7] * n)[:n]) for _ in range(5)] + [("walk", n, (letters * n)[:n])]
    low = defaultdict(list)
    for kind, n, value in rows:
        low[kind, n].append(battery(value) < 0.01)
    assert all(np.mean(v) <= 0.03 for (kind, _), v in low.items() if kind in ALPHABETS)
    assert all(np.mean(v) == 1 for (kind, n), v in low.items() if kind in ("loop", "walk") and n >= 100)


def test_long_runs_and_many_matches_in_one_text(spark):
    rng = np.random.default_rng(10)
    keys = np.frombuffer(ALPHABETS["base64"].encode(), np.uint8)
    image = bytes(keys[rng.integers(0, 64, 1_000_000)]).decode()
    many = " ".join(f"token={i:08d}" for i in range(100_000))
    texts = [(1, f"é {image} end"), (2, many), (3, "short")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    begin = time.time()
    found = {r["doc_id"]: r for r in secret_scan.scan(docs).collect()}
    assert found[2]["n_assign"] == 100_000 and found[2]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(many)).encode()).hexdigest()
    assert [(x["kind"], x["start"], x["end"]) for x in found[1]["found"]] == [("random", 2, 1_000_002)]
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(docs).collect()}
    assert clean == {1: "é [SECRET] end", 2: " ".join(["[SECRET]"] * 100_000), 3: "short"}
    assert time.time() - begin < 120
