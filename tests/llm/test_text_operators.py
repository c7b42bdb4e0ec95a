"""Extraction, personal data, secrets, languages, quality and toxicity on small tables, against plain versions."""

import base64
import bz2
import gzip
import hashlib
import lzma
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import quote

import numpy as np
import pytest

from pulsegrid.llm import compression_toxicity, crf_language, learning, pairwise_quality, pii, secret_scan, site_style_tree

DOCS = "doc_id long, text string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# Site style tree


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a>menu</a></nav><div class="sidebar">ads here</div>
<article><h1>Head  line</h1><p>One &amp; two<br>three</p><p>fo<b>ur</b></p></article><div id="comments"><p>reader</p></div>
<form>search</form><script>var x = "<p>no</p>";</script><footer>foot</footer></body></html>"""


def test_main_text():
    assert site_style_tree.main_text(PAGE) == "Head line One & two three four"
    assert site_style_tree.main_text(None) == site_style_tree.main_text("") == site_style_tree.main_text("<div></div>") == ""


def test_branches_that_repeat_over_a_host_go(spark):
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    page = lambda i: f'<div><div class="boxa"><p>Same words on each page</p></div><div class="boxb"><p>{words[i % 8]} {i} tells {i * 7}</p></div></div>'
    rows = [(i, f"http://a.example/{i}", page(i)) for i in range(40)] + [(40, None, None), (41, "http://b.example/x", "<p>lone</p>"), (7, "http://a.example/7", page(7))]
    got = site_style_tree.page_texts(frame(spark, rows, "page_id long, url string, html string")).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 43 and text[7] == "theta 7 tells 49" and text[40] == "" and text[41] == "lone"
    assert all("Same words" not in t for t in text.values()) and all(r.n_chars == len(r.text) for r in got)


def test_the_tree_decides_within_and_beside_articles(spark):
    page = lambda i: f'<article><p>Report {i} tells of {i * 7}</p><div class="boxa"><p>Same words on each page</p></div></article>'
    teaser = lambda i: f'<article><p>Teaser {i}</p></article><div class="boxc"><p>{" ".join(f"body{i * 50 + k}" for k in range(30))}</p></div>'
    again = lambda i: f"<article><p>One and the same</p></article><!-- {i} -->"
    rows = [(100 * k + i, f"http://{h}.example/{i}", make(i)) for k, (h, make) in enumerate({"a": page, "b": teaser, "c": again}.items()) for i in range(30)]
    text = {r.page_id: r.text for r in site_style_tree.page_texts(frame(spark, rows, "page_id long, url string, html string")).collect()}
    assert text[7] == "Report 7 tells of 49" and text[107].startswith("Teaser 7 body350 ") and text[207] == "One and the same"


def test_unclosed_and_wrapping_elements_lose_no_text():
    text = site_style_tree.main_text
    assert text("<article><p>one</p><svg/><p>two</p></article>") == "one two"
    assert text("<article><p>one</p><svg width='3'><g/><text>drawn</text></svg><p>two</p><select><p>three</p></article>") == "one two three"
    assert text('<div class="page has-sidebar no-comments"><div class="content"><p>long main text</p></div><div class="sidebar">aside</div></div>') == "long main text"
    assert text("<nav><div><p>menu</p></div></nav><p>said</p>") == "said"
    deep = "<div>" * 30_000 + "<p>inside</p>" + "</div>" * 30_000
    assert text(deep) == "inside" and len(site_style_tree.observations(deep)) == 90_003


class Plain(HTMLParser):
    """Styles and blocks of a well-formed page, by path."""

    def __init__(self):
        super().__init__()
        self.open, self.styles, self.blocks = [], [], []

    def handle_starttag(self, tag, attrs):
        label = ".".join([tag, *sorted(dict(attrs).get("class", "").split())])
        if self.open:
            self.open[-1][1].append(tag)
        self.open.append(((*(self.open[-1][0] if self.open else ()), label), []))

    def handle_endtag(self, tag):
        path, children = self.open.pop()
        self.styles.append((path, tuple(children)))

    def handle_data(self, data):
        if text := " ".join(data.split()):
            self.blocks += [(path, text) for path, _ in self.open]


def test_importance_is_the_entropy_over_pages(spark):
    rng = random.Random(3)
    pages = []
    for i in range(30):
        body = "".join(f"<p>{rng.choice(['same', 'other', f'own {i}'])}</p>" for _ in range(rng.randrange(1, 4)))
        pages.append(f'<div class="top"><h1>Site</h1></div><div class="boxa">{body}<ul>{"<li>entry</li>" * rng.randrange(1, 3)}</ul></div>')
    rows = [(i, f"http://{'ab'[i % 2]}.example/{i}", p) for i, p in enumerate(pages)] + [(99, "http://a.example/again", pages[0])]
    got = {(r.host, r.path): r for r in site_style_tree.style_tree(frame(spark, rows, "page_id long, url string, html string")).collect()}
    checked = 0
    for host, some in (("a.example", set(pages[::2])), ("b.example", set(pages[1::2]))):
        there, styles, blocks = {}, {}, {}
        for p in some:
            reader = Plain()
            reader.feed(p)
            for path in {x for x, _ in reader.styles}:
                there[path] = there.get(path, 0) + 1
            for x in set(reader.styles):
                styles.setdefault(x[0], Counter())[x[1]] += 1
            for x in set(reader.blocks):
                blocks.setdefault(x[0], Counter())[x[1]] += 1
        for path, n in there.items():
            code = 0
            for label in path:
                code = site_style_tree.path_code(f"{code}/{label}")
            r = got[host, code]
            p = np.array(list(styles[path].values())) / n
            # a page can have several styles at one path
            presentation = 1 - sum(c * np.log(c) for c in styles[path].values()) / (n * np.log(n))
            if p.sum() == 1:
                assert abs(presentation + (p * np.log(p)).sum() / np.log(n)) < 1e-9
            text = list(blocks.get(path, {}).values())
            content = 1 - sum(c * np.log(c) for c in text) / (sum(text) * np.log(n)) if text else 1.0
            assert r.pages == n and abs(r.presentation - presentation) < 1e-9 and abs(r.content - content) < 1e-9
            checked += 1
    assert checked >= 10 and len(got) == checked


def test_no_pages(spark):
    none = frame(spark, [], "page_id long, url string, html string")
    assert site_style_tree.page_texts(none).count() == 0 and site_style_tree.style_tree(none).count() == 0


def test_pages_keep_other_columns(spark):
    rows = [(1, "http://a.example", "<p>x</p>", "mine", "old")]
    got = site_style_tree.extract(frame(spark, rows, "page_id long, url string, html string, host string, text string")).first()
    assert (got.host, got.text, got.n_chars) == ("mine", "x", 1)


# Personal data


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                twice = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
                if not 16 <= len(digits) <= 19 or sum(twice) % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_are_those_of_the_patterns():
    random.seed(2)
    pieces = ["a@b.c", "@", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", " ", "é", "x_y%", "-", "9", "12", "\n", "0001.2.3.4.5", "a.b-c@d-e.f.g"]
    for _ in range(3000):
        text = "".join(random.choice(pieces) for _ in range(random.randrange(1, 12)))
        assert pii.base_spans(text) == plain_pii(text), text


def test_words_that_tell_an_entity_go(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(5))
    rows = [(i, f"{word()} {word()} {word()}") for i in range(150)]
    rows += [(200 + i, f"{word()} keeper Zorbulon writes from z.orb{chr(97 + i % 2)}@mail.example {word()}") for i in range(8)]
    rows += [(300, None), (301, ""), (200, rows[150][1]), (302, "x" * 300_000 + " a@b.cd")]
    got = pii.span_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text in rows:
        want = plain_pii(text or "")
        assert by[i].base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()
        assert by[i].spans.startswith(pii.joined(want)) and by[i].n_email == sum(k == "email" for k, _, _ in want)
    clean = pii.sanitise(frame(spark, [(*r, "mine", 5) for r in rows], f"{DOCS}, found string, n_chars int"))
    assert clean.columns == ["doc_id", "text", "found", "n_chars"] and clean.count() == len(rows)
    out = {r.doc_id: r for r in clean.collect()}
    assert "@" not in "".join(r.text or "" for r in out.values()) and out[300].text is None and out[205].found == "mine"
    assert "[EMAIL]" in out[205].text and out[205].n_chars == len(out[205].text)
    assert pii.span_report(frame(spark, [])).count() == 0


def plain_disclosures(texts):
    """Measure of every word near an entity that has the support, by loops."""
    near, anywhere, total = {}, {}, 0
    for text in texts:
        words = [(m.start(), m[0].lower()) for m in re.finditer("[A-Za-z0-9]+", text)]
        total += len(words)
        for _, w in words:
            anywhere[w] = anywhere.get(w, 0) + 1
        spans = plain_pii(text)
        outside = [(p, w) for p, w in words if not any(s <= p < e for _, s, e in spans)]
        for kind, s, e in spans:
            entity = text[s:e].lower()
            left = [k for k, (p, _) in enumerate(outside) if p < s][-8:]
            right = [k for k, (p, _) in enumerate(outside) if p >= e][:8]
            for part in {entity, entity[entity.rfind("@") :] if kind == "email" else entity[: entity.rfind(".") + 1] if kind == "ip" else entity}:
                for k in left + right:
                    if len(outside[k][1]) > 2 and not outside[k][1].isdigit():
                        sides = (outside[k - 1][1] if k else "", outside[k + 1][1] if k + 1 < len(outside) else "")
                        near.setdefault(part, {}).setdefault(outside[k][1], []).append(sides)
    out = {}
    for of in near.values():
        prior = sum(map(len, of.values())) / total
        for word, sides in of.items():
            perplexity = []
            for k in (0, 1):
                n = np.array(list(Counter(x[k] for x in sides).values())) / len(sides)
                perplexity.append(np.exp(-(n * np.log(n)).sum()))
            if min(perplexity) >= 3 - 1e-9:
                out[word] = max(out.get(word, -9), np.log(len(sides) / anywhere[word] / prior) / -np.log(prior))
    return out


def test_disclosing_words_are_those_of_the_counts(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    say = lambda n: " ".join(rng.choice([word(), "the"]) for _ in range(n))
    texts = [say(30) for _ in range(200)]
    # one entity in many texts, a word that is beside it in a few of them only, and one that is elsewhere too
    texts += [f"{say(3)} {word()} {'Nickname' if k < 4 else 'plain'} {word()} boss@firm.example {say(5)}" for k in range(30)]
    texts += [f"{say(4)} plain {say(3)}" for _ in range(40)]
    # an IP of a net that others share, and its site
    texts += [f"{say(5)} {word()} basement {word()} at 10.20.30.{k} {say(3)}" for k in range(5)]
    # near copies, the neighbours of whose words are the same but for a few
    copy = [word() for _ in range(12)]
    for k in range(60):
        mine = list(copy)
        mine[k % 12] = word()
        texts.append(" ".join([*mine[:6], "lone@other.example", *mine[6:]]))
    rows = [*enumerate(texts), (900, None), (901, "")]
    want = plain_disclosures(texts)
    got = {r.word: r.measure for r in pii.disclosing_words(frame(spark, rows), disclosure=-9.0).collect()}
    code = dict(zip(want, pii.word_codes(list(want)).tolist()))
    high = {code[w]: m for w, m in want.items() if m >= 0.9}
    assert {w for w, m in got.items() if m >= 0.9} == set(high) and all(abs(got[w] - m) < 1e-6 for w, m in high.items())
    told = {w for w, m in got.items() if m >= pii.DISCLOSURE}
    assert told == {code[w] for w in ("nickname", "basement")} and not {pii.word_codes([w])[0] for w in copy} & told
    # both ways of bringing the words to the texts
    few, many = (pii.find_spans(frame(spark, [(*r, "x") for r in rows], f"{DOCS}, of string"), broadcast_words=n) for n in (10, 0))
    assert few.columns == many.columns == ["doc_id", "text", "of", "base", "found"]
    assert {(r.doc_id, r.of, str(r.found)) for r in few.collect()} == {(r.doc_id, r.of, str(r.found)) for r in many.collect()}
    assert sum("term" in str(r.found) for r in few.collect()) == 9


def test_generalised():
    assert pii.generalised("abcdef", [("term", 1, 3), ("email", 2, 5), ("ip", 5, 6)]) == "a[TERM][IP]"


# Secrets


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def test_base_secrets_are_those_of_the_patterns():
    random.seed(6)
    pieces = ["password", "Token", "api_key", "APIKEY", "=", ": ", '"', "'", "abc123", "x", "AKIA", "AKIA" + "B7" * 9, "0f" * 12, "deadbeef", " ", "é", "secret='hunter2!'", "ſecret=abcdefg"]
    for _ in range(3000):
        text = "".join(random.choice(pieces) for _ in range(random.randrange(1, 10)))
        assert secret_scan.base_spans(text) == plain_secrets(text), text


def test_secrets_under_layers(spark):
    secret = "password = hunter2hunter2"
    wraps = {
        "url": quote(secret, safe=""),
        "unicode": "".join(f"\\u{ord(c):04x}" for c in secret),
        "base64": base64.b64encode(secret.encode()).decode(),
        "gzip": base64.b64encode(gzip.compress(secret.encode() * 3)).decode(),
        "twice": base64.b64encode(base64.b64encode(secret.encode())).decode(),
        "mixed": quote(base64.b64encode(zlib.compress(secret.encode())).decode(), safe=""),
    }
    rows = [(i, f"see {w} here") for i, w in enumerate(wraps.values())] + [(10, None), (11, ""), (12, secret), (12, secret), (13, "y " * 200_000 + secret)]
    got = {r.doc_id: r for r in secret_scan.secret_report(frame(spark, rows)).collect()}
    for i, w in enumerate(wraps.values()):
        spans = [s.split(":") for s in got[i].spans.split(",") if s.startswith("assign")]
        assert spans and all(int(s) >= 4 and int(e) <= 4 + len(w) for _, s, e in spans), (i, got[i])
    assert got[10].spans == got[11].spans == "" and got[12].n_assign == 1 and got[13].spans == f"assign:400000:{400000 + len(secret)}"


def test_secrets_of_no_rows_and_of_clashing_columns(spark):
    assert secret_scan.secret_report(frame(spark, [])).count() == 0
    got = secret_scan.find_secrets(frame(spark, [(1, "AKIA" + "A" * 16, "x"), (1, None, "y")], f"{DOCS}, base string")).collect()
    assert sorted(len(r.found) for r in got) == [0, 1] and {len(r.base) for r in got} == {0, 1}


def test_cycles_end():
    text = "%25" * 50 + base64.b64encode(b"again and again " * 4).decode()
    assert secret_scan.all_spans(text)[1] == secret_scan.all_spans(text)[1]


def test_each_place_of_an_encoded_secret_is_found():
    secret = "password = hunter2hunter2"
    one, packed = base64.b64encode(secret.encode()).decode(), base64.b64encode(gzip.compress(secret.encode())).decode()
    text = f"a {one} b {one}\nc {packed} d"
    at = [text.index(one), text.rindex(one), text.index(packed)]
    want = [("assign", s, s + n) for s, n in zip(at, (len(one), len(one), len(packed)), strict=True)]
    assert secret_scan.all_spans(text)[1] == want


def layers_of_a_long_secret():
    rng = random.Random(3)
    whole = ("".join(rng.choice("abcdefgh ijk\n") for _ in range(310)) + "password = hunter2hunter2").encode()
    out = {"lines": base64.encodebytes(whole).decode(), "strings": base64.encodebytes(whole).decode().replace("\n", "\\n")}
    for name, pack in (("gzip", gzip.compress), ("zlib", zlib.compress), ("bzip2", bz2.compress), ("xz", lzma.compress)):
        packed = pack(whole)
        out |= {f"{name} lines": base64.encodebytes(packed).decode(), f"{name} url": quote(packed), f"{name} string": repr(packed)}
        out |= {f"{name} escapes": "".join(f"\\u{c:04x}" for c in packed), f"{name} members": base64.b64encode(pack(b"none") + packed).decode()}
    return out


@pytest.mark.parametrize("name", list(layers_of_a_long_secret()))
def test_layers_are_read_whole(name):
    layer = layers_of_a_long_secret()[name]
    found = secret_scan.all_spans(f"see\n{layer}\nthere")[1]
    assert any(k == "assign" and 4 <= s < e <= 4 + len(layer) for k, s, e in found), (name, found)


@pytest.mark.parametrize("before", range(20))
def test_pieces_of_long_contents_overlap(monkeypatch, before):
    monkeypatch.setattr(secret_scan, "PIECE", 1000)
    secret = b"password = hunter2hunter2"
    for inside in (secret, quote(secret.decode(), safe="").encode(), base64.encodebytes(b"~" * 2000 + secret), b"password" + b" " * 3000 + b"= hunter2hunter2"):
        whole = b"\0" * (2980 + before) + inside + b"\xff"
        assert [k for k, _, _ in secret_scan.all_spans(base64.b64encode(gzip.compress(whole)).decode())[1]] == ["assign"], inside[:30]


# Languages


SYLLABLES = {"aa": ["ka", "lo", "mi", "ru"], "bb": ["sch", "ein", "ung", "tz"], "cc": ["ção", "nha", "lhe", "os"]}


def prose(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def language_rows():
    rng = random.Random(8)
    rows = [(i, prose(lang, rng.randrange(5, 60), rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    return rows + [(900, None, "aa"), (901, "", None), (902, "123 !? — “”", None), (903, prose("bb", 40_000, rng), None), (5, rows[5][1], None)]


def test_languages(spark):
    rows = language_rows()
    got = crf_language.language_report(frame(spark, rows, f"{DOCS}, lang string")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    held = [(by[i].lang_pred, lang) for i, _, lang in rows if lang and i < 900 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert {by[i].lang_pred for i in (900, 901, 902)} == {"und"} and by[903].lang_pred == "bb"


def test_words_of_switched_text(spark):
    rng = random.Random(9)
    model = crf_language.train([(t, lang) for _, t, lang in language_rows() if t and lang])
    found = crf_language.word_languages(prose("aa", 15, rng) + " " + prose("bb", 15, rng), model)
    assert sum(x[1] == ("aa" if k < 15 else "bb") for k, x in enumerate(found)) >= 27


def test_forward_backward_is_the_sum_over_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    emit, transition = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    want = np.zeros((7, 3))
    for path in itertools.product(range(3), repeat=7):
        # the start passes through one uniform transition
        weight = np.exp(transition[:, path[0]]).sum() * np.exp(sum(emit[t, y] for t, y in enumerate(path)) + sum(transition[a, b] for a, b in zip(path, path[1:])))
        for t, y in enumerate(path):
            want[t, y] += weight
    want /= want.sum(1, keepdims=True)
    assert np.allclose(crf_language.forward_backward(emit, np.array([0, 7]), transition), want)
    emit = rng.normal(size=(300, 3))
    whole = crf_language.forward_backward(emit, np.array([0, 300]), transition)
    both = crf_language.forward_backward(np.concatenate((emit, emit)), np.array([0, 300, 600]), transition)
    assert np.allclose(both[:300], whole) and np.allclose(both[300:], whole)


def test_texts_of_no_learned_language_fit_none(spark):
    rng = random.Random(31)
    rows = [(i, prose("ab"[i % 2] * 2, 60, rng), "ab"[i % 2] * 2) for i in range(400)]
    foreign = "wenn xylo quartz bevy jumped dwarf vexing plight hymn crypt zephyr gypsum wolf njord fjord glyph"
    rows += [(900, foreign, None), (901, None, None), (902, "", None), (903, "aa", None)]
    docs = frame(spark, [(*r, f"x{r[0]}") for r in rows], f"{DOCS}, lang string, fits string")
    got = {r.doc_id: r for r in crf_language.with_languages(docs, crf_language.fit(docs)).collect()}
    assert all(got[i].fits is True for i in range(400)) and not any(got[i].fits for i in (900, 901, 902))


def test_the_gradient_is_that_of_the_likelihood():
    import itertools

    import numpy as np

    rng = np.random.default_rng(8)
    score, transition = rng.normal(size=(3, 5, 3)), rng.normal(size=(3, 3))
    hot = np.eye(3)[rng.integers(0, 3, (3, 5))]

    def loss(score, transition):
        out = 0.0
        start = np.log(np.exp(transition).mean(0))
        for s, h in zip(score, hot):
            s = s.copy()
            s[0] += start
            paths = [sum(s[t, y[t]] for t in range(5)) + sum(transition[y[t], y[t + 1]] for t in range(4)) for y in itertools.product(range(3), repeat=5)]
            y = h.argmax(1)
            out += np.log(np.exp(paths).sum()) - sum(s[t, y[t]] for t in range(5)) - sum(transition[y[t], y[t + 1]] for t in range(4))
        return out

    by_score, by_transition = crf_language._gradient(score, hot, transition)
    for x, g in ((score, by_score), (transition, by_transition)):
        for at in np.ndindex(x.shape):
            old = x[at]
            x[at] = old + 1e-5
            up = loss(score, transition)
            x[at] = old - 1e-5
            down = loss(score, transition)
            x[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_without_labels_every_language_is_unknown(spark):
    got = crf_language.language_report(frame(spark, [(1, "some text", None)], f"{DOCS}, lang string")).first()
    assert got.lang_pred == "und" and crf_language.language_report(frame(spark, [], f"{DOCS}, lang string")).count() == 0


# Quality and toxicity


def test_quality(spark):
    rng = random.Random(10)
    good = lambda: prose("aa", rng.randrange(30, 90), rng).capitalize() + "."
    bad = lambda: " ".join([rng.choice(["buy $$$ now!!!", "click %%% here", "win win win"])] * rng.randrange(5, 20))
    rows = [(i, good() if i % 3 else bad()) for i in range(300)] + [(900, None), (901, ""), (902, good() * 3000), (4, good())]
    labels = frame(spark, [(i, int(i % 3 > 0), 0) for i in range(300)] + [(4, 1, 0), (950, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = pairwise_quality.quality_report(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [(r.predicted, int(r.doc_id % 3 > 0)) for r in got if r.held_out and r.doc_id < 300]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    none = pairwise_quality.quality_report(frame(spark, rows), labels.limit(0)).collect()
    assert len(none) == len(rows) and len({r.score for r in none}) == 1
    clash = pairwise_quality.with_scores(frame(spark, [(1, "a", "x")], f"{DOCS}, score string"), pairwise_quality.fit(frame(spark, rows), labels))
    assert clash.columns == ["doc_id", "text", "score", "predicted"] and isinstance(clash.first().score, float)
    assert pairwise_quality.quality_report(frame(spark, []), labels).count() == 0


def test_toxicity(spark):
    rng = random.Random(11)
    insult = ["vilething", "scoundrel", "wretch", "numbskull"]

    def toxic():
        words = prose("aa", rng.randrange(20, 80), rng).split()
        for _ in range(len(words) // 6):
            words[rng.randrange(len(words))] = rng.choice(insult) + rng.choice(["", "!!", ","])
        return " ".join(words)

    rows = [(i, toxic() if i % 4 == 0 else prose("aa", rng.randrange(20, 80), rng)) for i in range(500)] + [(900, None), (901, ""), (902, prose("aa", 30_000, rng)), (8, toxic())]
    labels = frame(spark, [(i, 1, int(i % 4 == 0)) for i in range(500)] + [(i, 1, 1) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in learning.agreed(labels, "toxic").collect()} == set(range(500)) - {1, 2, 3}
    got = compression_toxicity.toxicity_report(frame(spark, [(*r, "x") for r in rows], f"{DOCS}, score string"), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    held = [(r.predicted, int(r.doc_id % 4 == 0)) for r in got if r.held_out and r.doc_id < 500]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert {r.predicted for r in got if r.doc_id in (900, 901, 902)} == {0}
    assert compression_toxicity.toxicity_report(frame(spark, []), labels).count() == 0


@pytest.mark.parametrize("word", ["abc", "abcd", "abcdefghijklmnop"])
def test_units(word):
    got = compression_toxicity.units(word)
    assert word in got and all(word.startswith(u.rstrip("-")) for u in got)


def test_windows_are_the_text():
    raw = b"some words and " * 40 + b"x" * 500
    assert b"".join(compression_toxicity.windows(raw)) == raw
