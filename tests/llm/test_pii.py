import hashlib
import random
import re
import time

import pytest

from tamarack.llm import pii
from tamarack.llm.queries import op9_pii

from .helpers import documents, rows, table

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fine(kind, s):
    digits = re.sub(r"[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if fine(k, m[0])]


def test_base_is_the_contract():
    rng = random.Random(1)
    bits = ["a@b.co", "@", ".", "..", "-", "+", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111111", "+49 (30) 123-4567", " ", "x", "007", "é", "1.2.3.4.5.6.7.8", "a.b@c-d.e.f", "@x.y", "999"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 12)))
        assert pii.plain(t) == base(t), t


def test_whole_table(spark, sf_dir):
    d = documents(sf_dir)
    want = {i: base(t) for i, t in zip(d.doc_id, d.text)}
    for r in rows(op9_pii(spark, sf_dir)).itertuples():
        own = want[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in own) for k in pii.KINDS)
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in own)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert not own or all(x in r.spans.split(",") for x in text.split(","))


def added(text):
    return [(k, text[s:e]) for k, s, e in pii.spans(text)[1]]


def test_disguises():
    assert added("mail jane.doe [at] example [dot] com now") == [("email", "jane.doe [at] example [dot] com")]
    assert added("reach jane at example dot com.") == [("email", "jane at example dot com")]
    assert added("jane (AT) mail.example.org!") == [("email", "jane (AT) mail.example.org")]
    assert added("jane@example(dot)com") == [("email", "jane@example(dot)com")]
    assert ("email", "jоhn@example.com") in added("é jоhn@example.com")  # a Cyrillic o
    assert added("from １９２.168.0.1 it came") == [("ip", "１９２.168.0.1")]
    assert added("call plus four nine one five one two three four five six now") == [("phone", "plus four nine one five one two three four five six")]
    assert added("ip one nine two dot one six eight dot zero dot one") == [("ip", "one nine two dot one six eight dot zero dot one")]
    assert added("card 4111\u200b111111111111 x") == [("card", "4111\u200b111111111111")]
    assert added("card four one one one 1111 1111 1111 x") == [("card", "four one one one 1111 1111 1111")]


def test_clean_text_stays_clean():
    for t in ("we met at the inn dot", "point two is at hand", "a [dot] b", "one two three four", "un deux trois quatre", "Привет мир", "look at this point of view", "ª º ² ³"):
        assert pii.spans(t) == ([], []), t


def test_edges(spark):
    long = "a" * 100_000 + "@" + "1" * 100_000 + " " + "." * 1000
    texts = [None, "", "a@b.co", "a@b.co", long, "1" * 200_000]
    got = rows(pii.find(table(spark, texts)))
    assert list(got.base) == ["", "", "email:0:6", "email:0:6", "", ""]
    assert pii.find(table(spark, texts).where("doc_id < 0")).count() == 0


def test_dots_between_numbers():
    for ip in ("192[.]168[.]1[.]1", "192 dot 168 dot 1 dot 1", "10 dot 0 dot 0 dot one", "192 (dot) 168.1 punto 1", "10 point 0 point 0 point 7", "one nine two dot 168 punkt one dot 20"):
        assert added(f"host {ip}, up") == [("ip", ip)], ip
    for t in ("1 dot 2 dot 3", "300 dot 1 dot 1 dot 1", "192.168.1.1 dot", "point 1 point 2", "see [1] [2]. [3]"):
        assert added(t) == [], t


def test_at_and_dot_words_of_other_languages():
    assert added("mail jane arroba ejemplo punto com ya") == [("email", "jane arroba ejemplo punto com")]
    assert added("jean point dupont arobase exemple point fr") == [("email", "jean point dupont arobase exemple point fr")]
    assert added("jane arroba ejemplo.com") == [("email", "jane arroba ejemplo.com")]
    assert added("an jane at beispiel punkt de bitte") == [("email", "jane at beispiel punkt de")]
    assert added("jane at exemple point fr") == [("email", "jane at exemple point fr")]
    assert added("jane@exemple point fr") == [("email", "jane@exemple point fr")]
    for t in ("he looked at that point in time", "una arroba de trigo punto", "jane@example.com punto final", "write jane@example.com point of contact"):
        assert added(t) == [], t


def test_few_spelled_digits():
    assert added("ip one dot two dot three dot 4 ok") == [("ip", "one dot two dot three dot 4")]
    assert added("card 4111 1111 1111 one one one 1 ok") == [("card", "4111 1111 1111 one one one 1")]
    assert added("card 411111111111111 one ok") == [("card", "411111111111111 one")]
    assert added("card four 111 1111 1111 1111 ok") == [("card", "four 111 1111 1111 1111")]
    assert added("call +49 30 one two 3456 now") == [("phone", "+49 30 one two 3456")]
    assert added("call plus four 9 30 123456 now") == [("phone", "plus four 9 30 123456")]
    for t in ("chapter 3 one day", "2 one-way streets", "4111 1111 1111 one one one 2", "1, 2, 3, four", "plus one more"):
        assert added(t) == [], t


def test_dense_lists_are_not_cut():
    """Addresses that lie over the end of a search window keep their whole domain."""
    for pad in range(45):
        each = [f"jo [at] {'x' * (pad + 1)} dot com"] + [f"user{i} [at] mail dot example dot com" for i in range(40)]
        assert added("; ".join(each)) == [("email", e) for e in each], pad


def test_addresses_of_any_length():
    for n in (10, 299, 300, 320, 5000):
        text = f"write to joe [at] {'a' * n} [dot] com today"
        assert ("email", 9, len(text) - 6) in pii.spans(text)[1]
        text = f"write to {'b' * n} (dot) c at mail dot example dot org today"
        assert ("email", 9, len(text) - 6) in pii.spans(text)[1]


@pytest.mark.parametrize("text", ["x dot ", "x at ", "a dot b at ", "[at] ", "x [dot] ", " [at]      ", "one dot "])
def test_linear_time(text):
    began = time.perf_counter()
    pii.spans(text * 40_000)
    assert time.perf_counter() - began < 20


AT_FORMS = [" [at] ", "(at)", " at ", " {at} ", "[@]", "_at_", " arroba "]
DOT_FORMS = [" [dot] ", "(dot)", " dot ", "[.]", "_dot_"]
NAMES = "alex kim jordan sam river ash noor wren".split()
SPELL = "zero one two three four five six seven eight nine".split()
ALIKE = dict(zip(pii.LOOK_ALIKE.values(), pii.LOOK_ALIKE))


def disguised(rng):
    """One identifier in disguise: kind and text."""
    kind = rng.choice(pii.KINDS)
    if kind == "email":
        at = rng.choice(AT_FORMS)
        dot = rng.choice(DOT_FORMS[:2] if at == "_at_" else DOT_FORMS)
        return kind, f"{rng.choice(NAMES)}{rng.randrange(100)}{at}{rng.choice(NAMES)}{dot}{rng.choice(['com', 'org', 'net'])}"
    if kind == "ip":
        return kind, rng.choice([" dot ", "[.]", "(dot)", " [dot] "]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        digits = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        digits += next(c for c in "0123456789" if pii.luhn(digits + c))
        if rng.random() < 0.5:
            return kind, " ".join(SPELL[int(c)] for c in digits)
        return kind, "".join(chr(0xFF10 + int(c)) for c in digits)
    digits = "".join(rng.choice("123456789") for _ in range(11))
    if rng.random() < 0.5:
        return kind, "plus " + " ".join(SPELL[int(c)] for c in digits)
    return kind, "+" + "".join(chr(0x660 + int(c)) for c in digits)


def test_planted_disguises_have_their_source_spans():
    rng = random.Random(13)
    for _ in range(3000):
        before, after = ("".join(rng.choice(["the note says: ", "écrit; ", "wir sehen: ", "\n", "«x» "]) for _ in range(rng.randrange(3))) for _ in range(2))
        kind, hidden = disguised(rng)
        text = f"{before}; {hidden}; {after}"
        at = len(before) + 2
        base, added = pii.spans(text)
        assert (kind, at, at + len(hidden)) in added, text
        assert base == pii.plain(text)


def test_look_alikes_in_an_address():
    rng = random.Random(14)
    for _ in range(300):
        plain = f"{rng.choice(NAMES)}@{rng.choice(NAMES)}.com"
        hidden = "".join(ALIKE.get(c, c) if rng.random() < 0.4 else c for c in plain)
        if hidden != plain:
            assert ("email", 3, 3 + len(hidden)) in pii.spans(f"a: {hidden} b")[1], hidden


def test_letters_for_digits():
    assert added("card 4111 1111 1111 111l ok") == [("card", "4111 1111 1111 111l")]
    assert added("card 4111 1111 1111 111l I said") == [("card", "4111 1111 1111 111l")]
    assert added("host 1O.0.0.1, up") == [("ip", "1O.0.0.1")]
    assert added("host 10.0.0.l up") == [("ip", "10.0.0.l")]
    assert added("host l0.o.0.I up") == [("ip", "l0.o.0.I")]
    assert added("host 1O dot 0 dot 0 dot 1 up") == [("ip", "1O dot 0 dot 0 dot 1")]
    assert added("call +49 3O I23 4567 now") == [("phone", "+49 3O I23 4567")]
    for t in ("5l of oil", "lol.lol.I.o", "on 10. I said", "4111 1111 1111 111l2x", "jane2l@example.com", "1O.2.3", "4111 1111 1111 111o"):
        assert added(t) == [], t


def test_hyphens_blanks_and_false_starts():
    assert added("to jane-at-example-dot-com.") == [("email", "jane-at-example-dot-com")]
    assert added("to jane-dot-doe-AT-mail.x-y-dot-org, ok") == [("email", "jane-dot-doe-AT-mail.x-y-dot-org")]
    assert added("to jane @ example . com, ok") == [("email", "jane @ example . com")]
    assert added("to j.doe @ mail.example .de") == [("email", "j.doe @ mail.example .de")]
    assert added("an jane Klammeraffe beispiel punkt de bitte") == [("email", "jane Klammeraffe beispiel punkt de")]
    assert added("an jane (Klammeraffe) beispiel.de bitte") == [("email", "jane (Klammeraffe) beispiel.de")]
    for t in ("stay-at-home-mum dot", "stay-at-home", "dot-at-x-dot-1", "-at-x-dot-com", "we met @ noon . Then", "@ example . com", "twenty-one dot 10 dot 10 dot 10", "thirty-one dot two dot three dot 4", "ein Klammeraffe sitzt"):
        assert added(t) == [], t


def test_many_hints_are_read_in_linear_time():
    for storm in ("1l.", "-at-a-dot-", "a @ b . ", "O1 ", "a-at-", " @ x . com", "one-", "klammeraffe "):
        began = time.time()
        pii.spans(storm * (240_000 // len(storm)))
        assert time.time() - began < 5, storm
