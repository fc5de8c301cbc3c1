"""HTML text, personal data, SentencePiece, packing."""

import struct
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from lumenlog.llm import html_text, packing, pieces, pii
from lumenlog.llm.queries import BYTE_BPE, PIECE_BPE


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("  \n ", ""), ("just text", "just text"),
        ("<article><h1>Ti&eacute;</h1><p>one <b>tw</b>o\n three<p>four<br>five</article>", "Tié\n\none two three\n\nfour five"),
        ("<nav><a href=x>Home</a></nav><article><p>a<p>b</article><footer>c</footer>", "a\n\nb"),
        ("<header>Site</header><main><p>body</p><aside>side</aside><div class='ad-box'>buy</div></main>", "body"),
        ("<article><p>body</p><form><p>name</p></form><section id=comments><p>nice</p></section></article>", "body"),
        ("<article><p>a<script>if(a<b){'</p>'}</script>b</p><style>p{}</style><!-- <p>no</p> --></article>", "ab"),
        ("<div class=cookie-notice>We use cookies</div><div id=content><p>text</p></div>", "text"),
        ("<article><p>unclosed <b>bold<p>next &lt;tag&gt; &#8364;", "unclosed bold\n\nnext <tag> €"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one\n\ntwo\n\nx\n\ny"),
        ("<main><p>We ask how.</p><section id='discussion'><h2>Discussion</h2><p>Our results hold in all cases.</p></section></main>", "We ask how.\n\nDiscussion\n\nOur results hold in all cases."),
        ("<main><section id='related-work'><h2>Related work</h2><p>Others asked this before.</p></section><div class='share-price'><p>It rose by four.</p></div></main>", "Related work\n\nOthers asked this before.\n\nIt rose by four."),
        ("<article><p>The <nobr>new rule</nobr> starts in <output>May</output>, <my-tag>they say</my-tag>.</p></article>", "The new rule starts in May, they say."),
        ("<article><p>See chart <svg><g><text>42 percent</text></g></svg> below.</p></article>", "See chart below."),
        ("<article><p>x <noscript><div>Enable JS</div></noscript> y</p></article>", "x y"),
        ("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p></article>", "so x=2 holds"),
        ("<article><p>a<svg><path d='x'/><p>b</p></article>", "a\n\nb"),
        ("<article><p>A <button>Buy <div>now</div></button> B</p></article>", "A B"),
        ("<article><p>long enough to be text of its own</p><p>The end.</p></article><ul><li><a href=x>More</a><li><a href=y>Other</a></ul>", "long enough to be text of its own\n\nThe end."),
        ("<div class='site-header'>Brand</div><article><header><h1>T</h1></header><p>body text</p></article><div id='comments-area'><p>I like this</p></div>", "T\n\nbody text"),
    ],
)
def test_main_text(page, text):
    assert html_text.extract(page) == text


def test_tree_fits_its_table():
    model = html_text.tree()
    assert all(html_text.decide(model, row[:-1]) == row[-1] for row in html_text.LABELLED)


HAND_MARKED = """
-|<body><div id=top class=masthead>Daily <a href=/>Home</a></div>
-|<ul class=menu><li><a href=1>World</a><li><a href=2>Sport</a></ul>
-|<div class="cookie-banner">We use cookies to serve you. <button>OK</button></div>
+|<div class=story><h1>Bridge opens after repairs</h1>
+|<p>The old bridge over the river opened again on Monday, the city said.</p>
+|<p>It had been shut for two years, see <a href=3>our first report</a> on the cost.</p>
+|<h2>Alerts and delays</h2>
+|<p>Drivers should expect delays until the weekend while lamps are fitted.</p>
+|<blockquote>We are glad that it is done.</blockquote>
+|<p>The end.</p></div>
-|<div class=related-posts><h3>Related</h3><a href=4>Ferry stops</a> <a href=5>Road tax</a></div>
-|<div id=comments><p>About time that this was done, well done to all!</p></div>
-|<form><p>Your mail <input name=mail></p></form>
-|<div class=footer>All rights reserved <a href=6>Imprint</a></div></body>
"""


def test_hand_marked_page():
    lines = [x.split("|", 1) for x in HAND_MARKED.strip().split("\n")]
    text = lambda x: " ".join(html_text.re.sub("<[^>]*>", "", x).split())
    assert html_text.extract("\n".join(x for _, x in lines)) == "\n\n".join(text(x) for mark, x in lines if mark == "+")


@pytest.mark.parametrize("page", ["<div>{0}x{1}", "<div>{0}", "<p>{0}", "<ul><li><ul>{0}{1}"])
def test_odd_pages_take_time_in_proportion(page):
    n = 100_000
    for a, b in (("<div>", "</span>"), ("<b>", "</b>"), ("<a><div>", "</a>"), ("<svg><g>", "<p>"), ("<b>", "<li></li>")):
        started = time.process_time()
        assert isinstance(html_text.extract(page.format(a * n, b * n)), str)
        assert time.process_time() - started < 30


def test_pages(spark):
    rows = spark.createDataFrame([(1, "u", "<article><p>hi</article>", 5), (None, None, None, 5), (1, "u", "<article><p>hi</article>", 5)], "page_id long, url string, html string, text int")
    assert sorted(map(tuple, html_text.main_text(rows).collect()), key=repr) == [(1, "u", "hi", 2), (1, "u", "hi", 2), (None, None, "", 0)]
    assert html_text.main_text(rows.where("false")).count() == 0
    deep = "<div>" * 3000 + "x" + "</div>" * 3000 + "<a" * 3000
    assert isinstance(html_text.extract(deep), str)


@pytest.mark.parametrize("n", [2, 3, 7, 10, 97, 1000])
def test_permutations(n):
    p = pii.Pseudonyms()
    image = [p.permute(x, n, "t") for x in range(n)]
    assert sorted(image) == list(range(n)) and all(a != b for a, b in enumerate(image))
    assert image != [pii.Pseudonyms(b"other").permute(x, n, "t") for x in range(n)] or n < 4


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ("+1 (017) 555-7713", "phone"), ("4111 1111 1111 1111", "card"), ("4111111111111111", "card"), ("de.22@mail6.example.com", "email"), ("240.56.125.154", "ip"),
        ("DE89 3704 0044 0532 0130 00", "iban"), ("123-45-6789", "ssn"), ("2020-02-29", "date"), ("31.12.1999", "date"), ("3 March 2001", "date"), ("fe80::1", "ip"), ("é.1@x.org", "email"),
    ],
)
def test_formats(value, kind):
    p = pii.Pseudonyms()
    new, found = p.scan(f"see {value}, please")
    assert found == {kind: 1} and value not in new and new.startswith("see ") and new.endswith(", please")
    again, found = p.scan(new)  # a pseudonym is valid in its own format
    assert found == {kind: 1} and p.scan(f"{value}!")[0][:-1] == new[4:-8]
    if kind not in ("ip", "date"):
        assert [c.isdigit() for c in new[4:-8]] == [c.isdigit() for c in value]


@pytest.mark.parametrize(
    ("values", "same"),
    [
        (("+1 555 123 4567", "+15551234567", "+1 (555) 123-4567"), lambda x: "".join(c for c in x if c.isdigit())),
        (("+49 30 1234567", "+49301234567"), lambda x: "".join(c for c in x if c.isdigit())),
        (("Bob.M@x.com", "bob.m@x.com", "BOB.M@X.com"), str.lower),
        (("4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1111"), lambda x: "".join(c for c in x if c.isdigit())),
    ],
)
def test_spellings_of_a_value_stay_linked(values, same):
    assert len({same(pii.Pseudonyms().scan(v)[0]) for v in values}) == 1


@pytest.mark.parametrize("value", ["3. Mai 2021", "3 mai 2021", "14 AOÛT 1999", "3 de mayo de 2021", "1 de enero 1980", "March 3, 2001"])
def test_dates_in_four_languages(value):
    new, found = pii.Pseudonyms().scan(f"am {value}.")
    assert found == {"date": 1} and new != f"am {value}." and pii.Pseudonyms().scan(new)[1] == {"date": 1}
    assert pii.re.sub(r"[0-9]+|" + pii.MONTH, "", new) == pii.re.sub(r"[0-9]+|" + pii.MONTH, "", f"am {value}.")


@pytest.mark.parametrize(
    ("text", "left", "kind"),
    [("4111 1111 1111 1111 12/26", " 12/26", "card"), ("4111111111111111 123", " 123", "card"), ("BE68 5390 0754 7034 USA", " USA", "iban"), ("'de.2@mail.example.com'", "'", "email"), ("fe80:: is", " is", "ip")],
)
def test_values_beside_other_tokens(text, left, kind):
    new, found = pii.Pseudonyms().scan(text)
    assert found == {kind: 1} and new.endswith(left) and new != text


def test_planted_values_are_found_and_others_kept():
    """Brute force: every valid value that a text was made of is replaced, nothing else."""
    rng = np.random.RandomState(4)
    digits = lambda n: "".join(map(str, rng.randint(0, 10, n)))

    def card():
        body = "4" + digits(14)
        return body + str(-pii.luhn(body + "0") % 10)

    makers = [card, lambda: f"u{digits(3)}.x@m{digits(2)}.example.org", lambda: f"{rng.randint(1, 224)}.{rng.randint(256)}.{rng.randint(256)}.{rng.randint(256)}", lambda: f"20{rng.randint(10, 30)}-0{rng.randint(1, 10)}-1{rng.randint(10)}", lambda: f"+44 20 {digits(4)} {digits(4)}"]
    for _ in range(200):
        values = [makers[rng.randint(len(makers))]() for _ in range(4)]
        new, found = pii.Pseudonyms().scan("; ".join(f"word {v} word" for v in values))
        assert sum(found.values()) == 4 and new.count("word") == 8 and not any(v in new for v in values)


def test_odd_texts_take_time_in_proportion():
    for part in ("a'", "1 ", "a.", "1.", "a@", "1-", ":1", "(1", "+1 "):
        started = time.process_time()
        pii.Pseudonyms().scan(part * 40_000 + "@")
        assert time.process_time() - started < 20, part


@pytest.mark.parametrize("text", ["4111111111111112", "300.1.1.1", "version 2.0.", "2021-02-30", "000-12-3456", "DE00 3704 0044 0532 0130 00", "plain words", "", None])
def test_invalid_values_stay(text):
    assert pii.Pseudonyms().scan(text) == (text, Counter())


def test_pseudonymised_keeps_columns(edge, nothing):
    done = pii.pseudonymised(edge)
    assert done.columns == [*edge.columns, "pii"] and done.count() == edge.count()
    changed = [r for r in pii.op6(edge).collect() if r.n_replaced]
    assert [(r.doc_id, r.n_email, r.n_card) for r in changed] == [(10, 1, 1)]
    assert pii.op6(nothing).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a\nb", "日本 \x00 é", "👍🏽 ok", "\t", "don't stop", "a" * 300, "</s> <s> <0x41>"])
def test_sentencepiece_parity(text):
    codec = pieces.Codec(PIECE_BPE)
    raw, same = codec.encode([text])[0]
    ids = np.frombuffer(raw, "<u4")
    assert codec.cut and same and ids.tolist() == codec.peer.encode(text) and codec.decode(ids) == text
    assert codec.full.encode(text, add_special_tokens=False).ids == ids.tolist() or not text
    assert codec.full.decode(ids.tolist(), skip_special_tokens=False) == text


def test_unigram_models_are_rebuilt():
    spec = pieces.Spec([("<unk>", 0.0, 2), ("▁a", -1.0, 1), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1)], pieces.UNIGRAM, False, 0, False, b"", True, False)
    assert pieces.rebuild(spec).encode("ab a").tokens == ["▁a", "b", "▁a"]


def wired(field, value):
    """One protobuf field: numbers as varints, floats as four bytes, bytes as they are."""
    number = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)
    if isinstance(value, float):
        return number(field << 3 | 5) + struct.pack("<f", value)
    return number(field << 3) + number(value) if isinstance(value, int) else number(field << 3 | 2) + number(len(value)) + value


@pytest.fixture(scope="module", params=[True, False])
def unigram(request, tmp_path_factory):
    """A model file written by hand: unigram scores, with and without byte fallback."""
    rng = np.random.RandomState(3)
    plain = {"▁", *(f"{a}{b}{c}" for a in ("", "▁") for b in "abcdehilnort" for c in ("", *"aeiourst")), "▁the", "▁and", "ing", "é", "日本", "▁▁", "▁▁▁", "."}
    table = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if request.param else [])
    table += [(p, float(-2 - 9 * rng.rand()), 1) for p in sorted(plain)]
    raw = b"".join(wired(1, wired(1, p.encode()) + wired(2, s) + wired(3, k)) for p, s, k in table)
    raw += wired(2, wired(3, 1) + wired(35, int(request.param)) + wired(40, 0)) + wired(3, wired(1, b"identity") + wired(3, 1) + wired(4, 0) + wired(5, 1))
    path = tmp_path_factory.mktemp("models") / f"unigram{request.param}.model"
    path.write_bytes(raw)
    return str(path)


def test_unigram_ids_are_sentencepiece_s(unigram, documents):
    codec = pieces.Codec(unigram)
    assert codec.spec.kind == pieces.UNIGRAM and codec.cut
    texts = ["the rain and the sea", "a  b   c", " lead", "trail ", "日本 xyz é", "\n", "zzzz qqqq", "the   ", *(r.text or "" for r in documents.limit(40).collect())]
    for (raw, same), text in zip(codec.encode(texts), texts, strict=True):
        assert same and np.frombuffer(raw, "<u4").tolist() == codec.peer.encode(text)
        if codec.spec.byte_fallback:
            assert codec.decode(np.frombuffer(raw, "<u4")) == text


def test_differing_ids_are_reported():
    codec = pieces.Codec(PIECE_BPE)
    ids, at = codec.ids(["one two", "three"])
    assert codec.agrees(["one two", "three"], ids, at) == [True, True] and codec.returns(["one two", "three"], ids, at) == [True, True]
    ids[0] += 1
    assert codec.agrees(["one two", "three"], ids, at) == [False, True] and codec.returns(["one two", "three"], ids, at) == [False, True]


def test_encoded_tables(spark, documents, edge, nothing):
    rows = pieces.op5(documents, PIECE_BPE).collect()
    assert len(rows) == documents.count() and all(r.round_trip and r.parity and r.whole_parity is not False and r.n_tokens == len(r.ids) for r in rows)
    got = Counter((r.doc_id, r.text) for r in pieces.decoded(pieces.encoded(edge, PIECE_BPE), PIECE_BPE).collect())
    assert got == Counter((r.doc_id, r.text or "") for r in edge.select("doc_id", "text").collect())
    assert pieces.op5(nothing, PIECE_BPE).count() == 0


def test_every_whole_text_is_compared(documents, edge):
    for docs in (documents, edge):
        assert all(r.whole_parity is True for r in pieces.op5(docs, PIECE_BPE).collect())


ODD = ["a  b", "a   b", " a", "a ", "a\n b", "a\n \nb", "a \nb", "\n a b \n", "x\t y\n", "don't we'll  9", " ", "", "<|endoftext|> x <|endoftext|>", "日本 👍🏽"]


def test_packing_ids_are_the_library_s(documents):
    encoder = packing.Encoder(BYTE_BPE)
    for text in [*ODD, *(r.text or "" for r in documents.limit(60).collect())]:
        assert np.frombuffer(encoder(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 1_000_000 + "b"])
def test_packing_ids_of_very_long_white_space(text):
    encoder = packing.Encoder(BYTE_BPE)
    assert np.frombuffer(encoder(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_ids_where_the_core_fails(monkeypatch):
    encoder = packing.Encoder(BYTE_BPE)
    monkeypatch.setattr(packing, "LONG_SPACE", packing.re.compile("(?!)"))
    assert len(encoder(" " * 1_200_000)) > 0


def check_packing(docs, capacity=packing.CAPACITY):
    encoder = packing.Encoder(BYTE_BPE)
    rows = packing.op8(docs, BYTE_BPE).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for d in docs.select("doc_id", "text").collect():
        ids = np.append(np.frombuffer(encoder(d.text or ""), "<u4"), packing.END_ID).astype("<u4")
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want[d.doc_id] += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    return len(by_sequence), sum(r.length for r in rows)


def test_packing_tables(documents, edge, nothing):
    used, tokens = check_packing(documents)
    assert used <= -(-tokens // packing.CAPACITY) + 1
    check_packing(edge)
    assert packing.op8(nothing, BYTE_BPE).count() == 0


def fewest(sizes, capacity):
    """Brute force over partitions of a few sizes."""
    if not sizes:
        return 0
    first, rest = sizes[0], sizes[1:]
    return 1 + min(fewest([rest[i] for i in range(len(rest)) if i not in c], capacity) for n in range(len(rest) + 1) for c in combinations(range(len(rest)), n) if first + sum(rest[i] for i in c) <= capacity)


def test_plans_are_optimal_on_small_cases():
    rng = np.random.RandomState(0)
    for _ in range(40):
        sizes = rng.randint(1, 21, 7).tolist()
        counts = np.bincount(sizes, minlength=21)
        plan = packing.plan_sequences(counts, 20)
        assert sum(p.times for p in plan) == fewest(sizes, 20)
        assert all(sum(p.lengths) <= 20 for p in plan) and sum((np.bincount(p.lengths, minlength=21) * p.times for p in plan), np.zeros(21, int)).tolist() == counts.tolist()
    assert packing.plan_sequences(np.zeros(21, int), 20) == []
