import itertools
import math
import random
import re
import time

import pytest

from subsetry.llm import secret_scan


def noise(n, seed=3):
    rng = random.Random(seed)
    return "".join(rng.choices("ABCDxyz0189#!%&*", k=n)) + "x"


@pytest.mark.parametrize("lead", ["private_key: ", "auth=", "password" + " " * 30 + ":" + "\t" * 30, "aws_secret_access_key = ", "x-auth-token: ", "DB_PASSWORD=", "db_passphrase="])
@pytest.mark.parametrize("size", [20, 800])
def test_whole_values_after_any_name(lead, size):
    value = "x9$" + noise(size)
    assert secret_scan.redact(f"a {lead}{value} b").endswith("[SECRET] b") and value[-12:] not in secret_scan.redact(f"a {lead}{value} b")
    assert [(s.start, s.end) for s in secret_scan.find(f"a {lead}{value} b") if s.kind == "guess"] == [(2 + len(lead), 2 + len(lead) + len(value))]


def test_a_long_value_takes_linear_time():
    for piece in ("aA1!", "a", "qw", "Zx9#kQ2", "qwertyuiop"):
        began = time.perf_counter()
        secret_scan.guess_bits(piece * (40_000 // len(piece)))
        assert time.perf_counter() - began < 10


def plain_repeats(value):
    """The least cost by single characters and repeats only, by definition."""
    best, char = [0.0], secret_scan.math.log2(secret_scan._alphabet(value))
    for i in range(1, len(value) + 1):
        cost = best[i - 1] + char
        for size in (1, 2, 3, 4):
            for times in range(2, i // size + 1):
                if size * times >= 3 and value[i - size * times : i] == value[i - size : i] * times:
                    cost = min(cost, best[i - size * times] + 1 + size * char + secret_scan.math.log2(times + 1))
        best.append(cost)
    return best[-1]


def test_repeats_cost_as_defined():
    rng = random.Random(5)
    for _ in range(300):
        value = "".join(rng.choice(["b", "m", "bm", "bmbm", "mm", "0", "bbbbbb"]) for _ in range(rng.randint(1, 25)))
        assert secret_scan.guess_bits(value, secret_scan.Dictionary(())) == pytest.approx(plain_repeats(value))


def test_a_value_beside_a_base_span_is_judged_whole():
    t = "a password=correcthorse!Battery$taple9 b"
    assert [str(s) for s in secret_scan.find(t)] == ["assign:2:23", "guess:11:38"] and secret_scan.redact(t) == "a [SECRET] b"
    t = "auth=Zk#0123456789abcdef!Qv%tW9 b"
    assert [str(s) for s in secret_scan.find(t)] == ["guess:5:31", "hex:8:24"] and secret_scan.redact(t) == "auth=[SECRET] b"
    assert [s.kind for s in secret_scan.find('password = "abcdefghijklmnop"')] == ["assign"]


def segment_cost(value, part, words):
    """The least cost of part of value as one segment, by definition; infinite where it is none."""
    found, low = [], part.lower()
    if len(part) == 1:
        found.append(math.log2(secret_scan._alphabet(value)))
    if low in words:
        found.append(1 + math.log2(words.index(low) + 2) + (low != part))
    for size in (1, 2, 3, 4):
        times = len(part) // size
        if times >= 2 and len(part) >= 3 and part == part[:size] * times:
            found.append(1 + size * math.log2(secret_scan._alphabet(value)) + math.log2(times + 1))
    if len(part) >= 3 and all(pair in secret_scan._BESIDE for pair in zip(low, low[1:])):
        found.append(4 + math.log2(len(secret_scan._BESIDE) / 6) + 1.5 * (len(part) - 3))
    if re.fullmatch(r"(19|20)\d\d", part):
        found.append(1 + math.log2(120))
    if len(part) > 4 and secret_scan._DATE.fullmatch(part):
        found.append(1 + math.log2(120 * 366))
    return min(found, default=math.inf)


def test_the_cost_is_the_least_of_all_segmentations():
    rng, words = random.Random(8), ["password", "sun", "sunday", "day", "monkey"]
    pieces = ["sun", "Day", "SUNday", "monkey", "qwe", "asdf", "7", "x", "#", "aaa", "abab", "1999", "2019-05-07", "99"]
    for _ in range(250):
        value = "".join(rng.choices(pieces, k=rng.randint(1, 4)))[:13]
        least = math.inf
        for cuts in itertools.product((False, True), repeat=len(value) - 1):
            at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(value)]
            least = min(least, sum(segment_cost(value, value[a:b], words) for a, b in itertools.pairwise(at)))
        assert secret_scan.guess_bits(value, secret_scan.Dictionary(words)) == pytest.approx(least), value


def test_every_credential_value_is_costed(spark):
    rows = [(1, "password = abcdefghijklmnop"), (2, 'pwd: "Xk9#vQ2!mZ" and token: sunshine'), (3, "auth=zorguzorgubane"), (4, None), (5, "secret secret"), (6, "zorgu bane zorgu bane zorgu bane " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.scan(df).collect()}
    assert [(got[i].n_values, got[i].n_weak) for i in range(1, 7)] == [(1, 0), (2, 1), (1, 1), (0, 0), (0, 0), (0, 0)]
    assert got[1].spans == "assign:0:27" and got[1].costs.startswith("11:27:") and got[2].spans == "guess:6:16"
    # words that the corpus repeats are cheap; without it they cost brute force
    assert got[3].spans == "" and secret_scan.scan(df, words=secret_scan.USUAL).where("doc_id = 3").first().n_guess == 1
    found = secret_scan.dictionary_of(df).rank
    assert found["password"] == 1 and {"zorgu", "bane", "secret"} <= found.keys() and "sunshine" in found and "abcdefghijklmnop" not in found


def test_planted_values_are_found_and_weak_ones_left():
    rng = random.Random(12)
    signs = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz23456789!#%&*+?"
    names = ["password", "DB_PASSWORD", "api-key", "pwd", "client_secret", "passphrase", "credentials", "auth"]
    strong = ["".join(rng.choices(signs, k=rng.randint(10, 30))) for _ in range(500)]
    weak = ["".join(rng.sample(secret_scan.WORDS[:20], 1)) + rng.choice(["1", "123", "2019", "!", "aaaa", "qwerty"]) for _ in range(500)]
    hits = sum(any(s.start <= 12 + len(n) < s.end for s in secret_scan.find(f"some text {n}: {v} end")) for v in strong for n in [rng.choice(names)])
    false = sum(any(s.kind == "guess" for s in secret_scan.find(f"some text {rng.choice(names)}: {v} end")) for v in weak)
    assert hits >= 0.99 * len(strong) and false <= 0.01 * len(weak)
