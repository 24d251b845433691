"""Account numbers and scores against plain versions."""

import random
import re

from subsetry.llm import pii


def plain_mod97(s):
    """Remainder by 97, digit by digit, of the number with the first four characters last."""
    left = 0
    for c in s[4:] + s[:4]:
        for digit in str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)):
            left = (left * 10 + int(digit)) % 97
    return left == 1


def with_checksum(country, rest):
    """An account number whose check digits, found by trial, pass."""
    return next(country + f"{n:02d}" + rest for n in range(100) if plain_mod97(country + f"{n:02d}" + rest))


def plain_accounts(text):
    """Every longest run that passes: a country, two digits, 11 to 30 more with single blanks, nothing of their kind beside."""
    out, at = [], 0
    while at < len(text):
        m = re.match(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Z0-9])", text[at:]) if at == 0 or not re.match("[A-Z0-9]", text[at - 1]) else None
        if not m:
            at += 1
            continue
        for end in range(m.end(), 0, -1):
            whole = end == m.end() or text[at + end] == " "
            if whole and text[at + end - 1] != " " and 15 <= len(bare := text[at : at + end].replace(" ", "")) <= 34 and plain_mod97(bare):
                out.append((at, at + end))
                break
        at += m.end()
    return out


def plain_score(text, kind, start, end):
    near = text[max(0, start - 40) : start].lower() + " " + text[end : end + 40].lower()
    score = pii.PRIOR[kind]
    if any(near.find(w) >= 0 for w in pii.LIKELIER[kind]):
        score += 0.15
    if any(near.find(w) >= 0 for w in pii.UNLIKELIER[kind]):
        score -= 0.3
    return round(min(max(score, 0), 1), 2)


def texts(n, seed):
    rng = random.Random(seed)
    good = [with_checksum(c, "".join(rng.choices("0123456789", k=k))) for c, k in (("DE", 18), ("GB", 14), ("FR", 23), ("NO", 11))]
    grouped = [" ".join(x[i : i + 4] for i in range(0, len(x), 4)) for x in good]
    wrong = [x[:-1] + str((int(x[-1]) + 1) % 10) for x in good]
    words = ["bank", "IBAN", "serial", "part", " ", ". ", "account:", "é", "X", "call", "+47 22 33 44 55", "4111 1111 1111 1111", "10.0.0.1", "version", "a@b.co", "noreply@example.com", "filler text " * 5]
    return ["".join(rng.choice([*good, *grouped, *wrong, *words]) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(1, 10))) for _ in range(n)]


def test_accounts_and_scores_equal_plain_versions():
    kept = left = 0
    for t in texts(1500, 3):
        found = pii.find(t, least=0)
        assert [(s.start, s.end) for s in found if s.kind == "iban"] == plain_accounts(t), repr(t)
        assert all(s.score == plain_score(t, s.kind, s.start, s.end) for s in found)
        now = pii.find(t)
        assert now == [s for s in found if s.kind != "iban" or s.score >= pii.LEAST]
        kept, left = kept + len(now), left + len(found) - len(now)
    assert kept > 1000 and left > 20


def test_scores_are_in_the_result(spark):
    rows = [(1, "IBAN NO93 8601 1117 947 of the bank"), (2, "serial part NO9386011117947"), (3, "version 1.2.3.4 and host 10.0.0.1"), (4, None)]
    got = {r.doc_id: r for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].spans, got[1].scores, got[1].n_sure, got[1].best) == ("iban:5:23", "0.85", 1, 0.85)
    assert (got[2].spans, got[2].n_iban, got[2].best) == ("", 0, 0.0)
    assert got[3].scores == "0.45,0.45" and got[3].n_ip == 2 and got[4].scores == ""
