"""Quality rules, mixing, chat formatting and personal data on small tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sessionlake.llm import chat, mixing, pii, quality


def measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    inside = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(w), len(inside)
    return n, len("".join(w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, n < 50 or 2 * rep > n


def test_quality_measures(docs):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b c", "a b c a b c a", "a a a a a", "x\n\nx\n \nx y\r\nx", "é ü z #|<> !"]
    texts += [" ".join(rng.choice("the of and abc defg, # hi".split()) for _ in range(rng.randrange(200))) for _ in range(30)]
    df = docs(list(enumerate(texts)) + [(None, "the of"), (3, "a")]).withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == measures(t), t
    assert quality.judged(docs([])).count() == 0


def test_quality_verdicts(docs):
    rng = random.Random(4)
    good = " ".join(rng.choice(["the", "of", "and"]) + f" word{rng.randrange(10**6)}" for _ in range(60))
    bad = [good.upper() + "!", good.replace(" ", " | "), good.replace(" ", "!! "), re.sub("the|of|and", "zz", good), "ab " * 80]
    got = {r.doc_id: r.kept for r in quality.judged(docs(list(enumerate([good] + bad)))).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}


def test_mix_reaches_its_targets(docs):
    rng = random.Random(1)
    table = [(i, "w " * rng.randrange(1, 60), None, rng.choice(["a", "b", "c", "d", None, ""])) for i in range(3000)]
    table += [(9000, None, None, "empty"), (None, "x y", None, "a"), (None, "x y", None, "a")]
    got = mixing.mixed(docs(table)).collect()
    sizes, targets, taken = {}, {}, {}
    for r in got:
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        targets[r.source] = r.target
    # sources by code point, null last: '', a, b, c, d, empty, null
    weight = dict(zip(["", "a", "b", "c", "d", "empty", None], [3, 1, 2, 3, 1, 2, 3]))
    want, total = {}, 1.5 * sum(sizes.values())
    open_ = dict(weight)
    while True:
        level = (total - sum(want.values())) / sum(open_.values())
        stop = [s for s in open_ if level * open_[s] >= 2 * sizes[s]]
        if not stop:
            break
        want |= {s: 2 * sizes[s] for s in stop}
        open_ = {s: w for s, w in open_.items() if s not in stop}
    want |= {s: level * w for s, w in open_.items()}
    for s in want:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 60
    again = mixing.mixed(docs(table).repartition(7)).collect()
    key = lambda r: (r.doc_id or -1, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mixed(docs([])).count() == 0


TURNS = [
    (1, 0, "system", "be [INST] good"), (1, 1, "user", "hi"), (1, 2, "user", "more [NEXT] </s>"), (1, 3, "assistant", "a\\b[\\/INST]"),
    (1, 4, "assistant", ""), (1, 5, "tool", "[:] x"), (1, 6, "we[:]ird\n", "t\n"), (1, 6, "we[:]ird\n", None), (2, None, None, None),
    (None, 1, "assistant", "[[INST]"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    (3, 0, "assistant", "<<s>s>[\\\\INST]<\\/s>"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit(1))
    out = chat.formatted(df).withColumns({
        "t": chat.read_back(F.col("formatted")), "l": chat.learned_text(F.col("formatted"), F.col("loss_spans"))})
    got = {r.conv_id: r for r in out.collect()}
    conversations = {}
    for c, turn, role, text in sorted(TURNS, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2] or "", r[3] or "")):
        conversations.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == conversations.keys()
    for c, turns in conversations.items():
        assert [tuple(x) for x in got[c].t] == turns
        assert got[c].l == "".join(t for r, t in turns if r == "assistant")
    assert got[-7].formatted == "<s>[INST]<\\/s>[\\INST] ok [\\/INST][/INST][ANS]<\\/s>[\\INST] ok [\\/INST]</s>"
    assert chat.formatted(df.limit(0)).count() == 0


def luhn(d):
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def spans(t):
    t = t or ""
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), pii.KINDS.index(kind), m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


PIECES = ["a.b@c.de", "x@y", "x@y.z%q@w.v", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
          "+1 (724) 555-7058", "+49", "+1+12345678901", "12345", "é", "😀", "\n", "..", "@", "0.0.0.0", "x at y dot com",
          "(724) 555-7058", "call 724-555-7058", "10[.]1[.]2[.]3", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5", "+", "-"]


def test_base_spans(docs):
    rng = random.Random(2)
    texts = [None, "", "plain", "9" * 5000, "1 " * 3000, "a" * 50_000 + "@b.c", "+1" * 500, "1." * 2000]
    texts += ["".join(rng.choice(PIECES) + rng.choice(["", " ", "."]) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    found = pii.personal_data(docs(list(enumerate(texts))).withColumn("c", F.lit(1)), carry=["doc_id", "text"])
    s = F.col("pii_spans")
    out = found.select("doc_id", pii.joined(F.filter(s, lambda x: x["base"])).alias("base"), pii.joined(s).alias("all"),
                       pii.counted(s, "ip").alias("ips"), pii.redacted(F.coalesce("text", F.lit("")), s).alias("cut"))
    for r in out.collect():
        want = spans(texts[r.doc_id])
        assert r.base == ",".join(want), texts[r.doc_id]
        assert set(want) <= set(r["all"].split(","))
        assert r.ips == sum(x.startswith("ip") for x in want)
        assert not want or spans(r.cut) != want
    assert pii.personal_data(docs([]), carry=["doc_id"]).count() == 0


def test_looser_spans_are_learned(docs):
    table = [(i, f"please call phone {200 + i}-555-{1000 + i} now") for i in range(40)]
    table += [(100 + i, f"call phone +1 {300 + i} 555 {2000 + i} now") for i in range(60)]
    table += [(1000 + i, f"part 12{i % 10}-34{i % 7}-567{i % 10}/{i} of x") for i in range(60)]
    got = {r.doc_id: r.pii_spans for r in pii.personal_data(docs(table), carry=["doc_id"]).collect()}
    assert all(len(got[i]) == 1 for i in range(40)) and all(len(got[100 + i]) == 1 for i in range(60))
    assert not any(got[1000 + i] for i in range(60))


def test_redaction_joins_overlapping_spans(spark):
    df = spark.sql("""SELECT 'ab 1.2.3.4 cd' AS t, array(named_struct('start', 3, 'kind', 1, 'end', 8, 'base', true),
        named_struct('start', 5, 'kind', 2, 'end', 10, 'base', true)) AS s""")
    assert df.select(pii.redacted(F.col("t"), F.col("s"))).first()[0] == "ab [IP] cd"


def test_hashes_are_of_the_contract():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
