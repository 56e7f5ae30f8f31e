"""Packing, mixing and personal information."""

import collections
import datetime as dt
import random
import re

import numpy as np
import pytest

from codeloom.llm import mixing, packing, pii
from codeloom.llm.feistel import date_pseudonym, name_pseudonym, pseudonym, restore
from codeloom.llm.tokens import encoding, tokenizer_path

DOCS = "doc_id long, text string, source string"
WORDS = [f"w{i}" for i in range(400)]


def texts(n, seed=1, topics=4):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        topic = i % topics
        out.append((i, " ".join(rng.choice(WORDS[topic * 100 : topic * 100 + 100]) for _ in range(rng.choice([3, 20, 60, 200, 700]))), f"S{topic} "))
    return out


def test_packing_places_every_token_once(spark):
    rows = [*texts(150), (900, None, "x"), (901, "", "x"), (902, "   long " * 5000, "x"), (None, "lost", "x"), *texts(3)]
    sizes = [("small", 128), ("big", 1024), ("big", 1000), ("none", None), ("zero", 0), (None, 5)]
    placed = packing.packed(spark.createDataFrame(rows, DOCS), spark.createDataFrame(sizes, "container_name string, capacity_tokens int")).collect()
    enc = encoding(tokenizer_path())
    length = {i: len(enc.encode_ordinary(t or "")) for i, t, _ in rows if i is not None}
    for name, capacity in (("small", 128), ("big", 1024)):
        own = [r for r in placed if r["container_name"] == name]
        held = collections.defaultdict(list)
        used = collections.Counter()
        for r in own:
            held[r["doc_id"]].append((r["first_token"], r["n_tokens"]))
            used[r["container_id"]] += r["n_tokens"]
        assert max(used.values()) <= capacity
        for i, n in length.items():
            at = 0
            for first, size in sorted(held[i]):
                assert first == at
                at += size
            assert at == n
            assert len(held[i]) == -(-n // capacity)
        assert sum(used.values()) / (len(used) * capacity) > 0.9
    assert {r["container_name"] for r in placed} == {"small", "big"}


def test_packing_prefers_neighbours(spark):
    rows = [(i, " ".join(["river stone cloud forest meadow", "debt ledger audit invoice claim"][i % 2].split()[j % 5] for j in range(60)), "s") for i in range(16)]
    placed = packing.packed(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("c", 250)], "container_name string, capacity_tokens int")).collect()
    together = collections.defaultdict(set)
    for r in placed:
        together[r["container_id"]].add(r["doc_id"] % 2)
    assert sum(len(x) == 1 for x in together.values()) >= len(together) - 1


def test_packing_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert packing.packed(empty, spark.createDataFrame([("c", 8)], "container_name string, capacity_tokens int")).count() == 0


def test_index_scores_against_brute_force():
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 60, 20), return_counts=True) for _ in range(40)]
    frequencies = np.bincount(np.concatenate([d[0] for d in docs]), minlength=60)
    mean = float(np.mean([d[1].sum() for d in docs]))
    index = packing.Index([d[0].astype(np.uint32).tobytes() for d in docs], [d[1].astype(np.uint32).tobytes() for d in docs], frequencies, 40, mean)

    def weight(term, doc):
        ids, counts = docs[doc]
        tf = counts[ids == term].sum()
        idf = np.log1p((40 - frequencies[term] + 0.5) / (frequencies[term] + 0.5))
        return idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * counts.sum() / mean)) if tf else 0.0

    expected = [sum(weight(t, d) for t in docs[3][0]) for d in range(40)]  # all tokens of the document ask
    others = [d for d in range(40) if d != 3]
    assert np.allclose(index.scores(3)[others], np.array(expected)[others], rtol=1e-4)


def test_neighbours_meet_in_a_shard(spark, monkeypatch):
    """Of the ten best neighbours over all rows of ids divisible by 50, at least nine in ten lie in the document's own shard."""
    monkeypatch.setattr(packing, "SHARD", 170)
    inside, chance = packing.neighbour_recall(spark.createDataFrame([r for r in texts(800, seed=5) if len(r[1].split()) >= 20], DOCS))
    assert inside >= 0.9 and chance < 0.5


TARGETS = "mix_name string, source string, weight double, max_repeats int"


def test_mixing_reaches_shares(spark):
    rows = [*texts(400), (1000, None, "s0"), (1001, "orphan text", None), (1002, "other", "unlisted")]
    targets = [("m", "s0", 1.0, 1), ("m", "s1", 1.0, 2), ("m", "s2", 2.0, 3), ("m", "missing", 1.0, 1), ("n", "s3", 0.5, 2), ("n", None, 1.0, 1), ("n", "s1", -1.0, 1), ("n", "s2", 0.5, 0)]
    chosen, shares, fit = mixing.chosen(spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS))
    assert fit.label_error < 0.001 and fit.passes < mixing.PASSES
    caps = {(m, s): r for m, s, _, r in targets if s}
    picked = chosen.collect()
    assert len({(r["mix_name"], r["doc_id"]) for r in picked}) == len(picked)
    assert all(0 < r["repeats"] <= caps[r["mix_name"], r["source"]] for r in picked)
    got = {(r["mix_name"], r["source"]): (r["target_share"], r["reached_share"]) for r in shares.collect()}
    assert got["m", "missing"] == (0.0, 0.0)
    for source, share in (("s0", 0.25), ("s1", 0.25), ("s2", 0.5)):
        assert got["m", source][0] == pytest.approx(share) and got["m", source][1] == pytest.approx(share, abs=0.01)
    assert got["n", "s3"] == (1.0, 1.0)


def test_mixing_of_nothing(spark):
    chosen, shares, _ = mixing.chosen(spark.createDataFrame([], DOCS), spark.createDataFrame([("m", "a", 1.0, 1)], TARGETS))
    assert chosen.count() == 0 and [tuple(r)[:5] for r in shares.collect()] == [("m", "a", 1.0, 0.0, 0.0)]
    assert mixing.chosen(spark.createDataFrame(texts(5), DOCS), spark.createDataFrame([], TARGETS))[1].count() == 0


def test_memberships_follow_the_text_where_labels_are_wrong(spark):
    """A tenth of the labels is wrong: those documents become members of the source their text comes from."""
    rows = [(i, text, f"S{(i + (i % 10 == 0)) % 4}") for i, text, _ in texts(600)]
    right, wrong = [], []
    seen = {}
    original = mixing.pin

    def spy(df, label="table"):
        out = original(df, label)
        if label == "soft":
            seen["rows"] = out.collect()
        return out

    mixing.pin = spy
    try:
        mixing.chosen(spark.createDataFrame(rows, DOCS), spark.createDataFrame([("m", f"s{k}", 1.0, 1) for k in range(4)], TARGETS))
    finally:
        mixing.pin = original
    for r in seen["rows"]:
        if r["n_tokens"] >= 100:
            (wrong if r["doc_id"] % 10 == 0 else right).append(int(np.argmax(r["member"])) == r["doc_id"] % 4)
    assert len(wrong) >= 20 and np.mean(right) > 0.98 and np.mean(wrong) > 0.6


def test_classifier_on_held_out_texts():
    enc = encoding(tokenizer_path())
    rows = [np.unique(np.array(enc.encode_ordinary(t), dtype=np.uint32), return_counts=True) for _, t, _ in texts(200)]
    x = np.array([mixing.features(i.tobytes(), c.astype(np.uint32).tobytes()) for i, c in rows])
    y = np.arange(200) % 4
    w = mixing.fit_softmax(x[:120], y[:120], 4)
    assert (mixing.predict(w, x[120:]).argmax(axis=1) == y[120:]).mean() > 0.9


PLAIN = {
    "Write to <a.b+c@x-y.example>, or mailto:Q_z7@m.n.test.": [("email", "a.b+c@x-y.example"), ("email", "Q_z7@m.n.test")],
    "Tel. 020 7946 0837, +44 (0)7700 900 426, (202) 555-0173; on 12/03/2019 £307,386.00": [("phone", "020 7946 0837"), ("phone", "+44 (0)7700 900 426"), ("phone", "(202) 555-0173")],
    "Rückfragen unter Tel.: 030/23125303 am 12.03.2019": [("phone", "030/23125303")],
    "holder of passport X09416328, NI no. QQ120573A, National Insurance number QQ 23 53 28\nD, social security number 915-82-6176; invoice no. 46-73836; policy (no. 8651-3)": [("id_number", "X09416328"), ("id_number", "QQ120573A"), ("id_number", "QQ 23 53 28\nD"), ("id_number", "915-82-6176")],
    "(Steuer-ID 98 282 557 625) (Versicherungsnummer 65599038P339) (Reisepass C0M48CC24)": [("id_number", "98 282 557 625"), ("id_number", "65599038P339"), ("id_number", "C0M48CC24")],
    "carte d'identité 427878CV3101, no de sécurité sociale 9 49 07 99 724 876 20; No RG 21/0006929": [("id_number", "427878CV3101"), ("id_number", "9 49 07 99 724 876 20")],
    "of Flat 11, 205 Priory Rd., Quillmarsh QX3 6DL and 4A Priory St, Eastmere (appellant)": [("address", "Flat 11, 205 Priory Rd., Quillmarsh QX3 6DL"), ("address", "4A Priory St, Eastmere")],
    "wohnhaft Tannenstr. 119 b, 99937 Neuhallen, demeurant 44 bis rue du\nMoulin-Neuf, 99615 Marlieu": [("address", "Tannenstr. 119 b, 99937 Neuhallen"), ("address", "44 bis rue du\nMoulin-Neuf, 99615 Marlieu")],
    "Before: Judge Quenby Falevik. Mr O'Wexby's log; Falevik said that FALEVIK Quenby and Q. Falevik agree. Falevik Foods Ltd": [("name", "Quenby Falevik"), ("name", "O'Wexby"), ("name", "Falevik"), ("name", "FALEVIK Quenby"), ("name", "Q. Falevik")],
    "Herr Dr. von Morgenwald, Neskermar-Vance, Quenby; Mme Isaure J.\nSanmoquin; P. N. and Mx X": [("name", "von Morgenwald"), ("name", "Neskermar-Vance, Quenby"), ("name", "Isaure J.\nSanmoquin")],
    "ET : ISAURE DE SANMOQUIN\n\nVON MERZAHN Quenby. M. Valreville; le contrat de travail de Valreville": [("name", "ISAURE DE SANMOQUIN"), ("name", "VON MERZAHN Quenby"), ("name", "Valreville"), ("name", "Valreville")],
    "Her Honour Judge Quenby Falevik\n\nMr. M.\n\nHBCC-2021-0004646": [("name", "Quenby Falevik")],
    "Judge Yard0ne sat.": [("name", "Yard0ne")],
    "": [],
}


@pytest.mark.parametrize("text", PLAIN)
def test_pieces(text):
    finder = pii.Finder(["Quenby", "Isaure"])
    assert [(k, text[a:b]) for k, a, b in finder.find(text)] == PLAIN[text]


def test_lexicon_and_operator(spark):
    rows = [(i, f"Mr Ansel Wex{chr(97 + i)}by came. Later Ansel Merowel left, as did Wex{chr(97 + i)}by.", "s") for i in range(6)] + [(50, None, "s"), (51, "", "s"), (None, "Mr Ansel Lost", "s"), (0, "Mr Ansel Wexaby came. Later Ansel Merowel left, as did Wexaby.", "s")]
    docs = spark.createDataFrame(rows, DOCS)
    given, _ = pii.lexicons(docs)
    assert given == ["Ansel"]
    found = pii.pieces(docs).collect()
    assert len(found) == 18 and {r["pii_type"] for r in found} == {"name"}
    hidden = {r["doc_id"]: r for r in pii.masked(docs, "k").collect()}
    assert hidden[50]["text"] is None and hidden[51]["text"] == ""
    assert re.fullmatch(r"Mr \[NAME:\w+ \w+\] came\. Later \[NAME:\w+ \w+\] left, as did \[NAME:\w+\]\.", hidden[1]["text"])


def test_names_stay_linked_by_their_words():
    key = b"k"
    full, alone = name_pseudonym("Quenby von Müller", key), name_pseudonym("Müller", key)
    assert full.split()[1:] == ["von", alone] and name_pseudonym("MÜLLER", key) == alone.upper()
    assert "ü" not in alone.lower() and "Müller" not in full
    for name in ("Q. O'Wexby-Élan", "Жук", "Straße", "d’Été", ""):
        assert name_pseudonym(name_pseudonym(name, key), key, False) == name


def test_feistel_is_a_permutation_of_its_format():
    assert len({pseudonym(f"{i:04d}", b"k") for i in range(10_000)}) == 10_000
    for value in ("+44 (0)7700 900 426", "QQ 23 53 28 D", "a.b@c.example", "7", "", "Élan-9", "X" * 300):
        hidden = pseudonym(value, b"k")
        assert restore(hidden, b"k") == value
        form = lambda text: "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in text)
        assert form(hidden) == form(value)
    assert pseudonym("Abc", b"k").lower() == pseudonym("ABC", b"k").lower()
    assert pseudonym("1234567", b"k") != pseudonym("1234567", b"other")
    days = [dt.date(1999, 12, 31) + dt.timedelta(n) for n in range(400)]
    assert [date_pseudonym(date_pseudonym(d, b"k"), b"k", forward=False) for d in days] == days


def test_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(texts(20), DOCS)
    for name in ("n_tokens", "ids", "counts", "shard", "mix_name", "rate", "label", "pii_type", "word", "n"):
        docs = docs.withColumn(name, F.lit(None).cast("string"))
    sizes = spark.createDataFrame([("c", 256, "x")], "container_name string, capacity_tokens int, doc_id string")
    targets = spark.createDataFrame([("m", "s0", 1.0, 1, "x")], TARGETS + ", n_tokens string")
    assert packing.packed(docs, sizes).select("doc_id").distinct().count() == 20
    assert {r["source"] for r in mixing.chosen(docs, targets)[0].collect()} == {"s0"}
    assert pii.pieces(docs).count() == 0


def test_lexicons_keep_every_name_or_refuse(spark, monkeypatch):
    names = [chr(65 + k % 26) + "".join(chr(97 + (k // 26**j + 7 * j) % 26) for j in range(1, 4)) + "en" for k in range(60)]
    monkeypatch.setattr(pii, "MOST_GIVEN", 10, raising=False)
    monkeypatch.setattr(pii, "MOST_SURNAMES", 20, raising=False)
    rows = [(k, f"Mr {name} Quillson spoke.") for k, name in enumerate(sorted(set(names)) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given, surnames = pii.lexicons(docs)
    assert set(given) == set(names) - pii.COMMON and surnames == ["Quillson"]
    monkeypatch.setattr(pii, "MOST_NAMES", 10, raising=False)
    with pytest.raises(ValueError, match="names"):
        pii.lexicons(docs)


def test_addresses_of_single_digits():
    text = "Notice. 7 High Street, Leeds LS1 4AB is closed."
    assert [(kind, text[a:b]) for kind, a, b in pii.Finder([]).find(text)] == [("address", "7 High Street, Leeds LS1 4AB")]


def test_numbers_are_held_against_formats_they_can_have_only(monkeypatch):
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.tried = pattern, 0

        def match(self, *at):
            self.tried += 1
            return self.pattern.match(*at)

    counted = [Counted(p) for p in (*pii.ADDRESSES, pii.GERMAN_ADDRESS, pii.PHONE)]
    monkeypatch.setattr(pii, "ADDRESSES", counted[:2])
    monkeypatch.setattr(pii, "GERMAN_ADDRESS", counted[2])
    monkeypatch.setattr(pii, "PHONE", counted[3])
    finder = pii.Finder([])
    assert finder.find("paid 1200 euro, 35 per cent of 4711 items, art. 12 and 13 of 1998, ") == []
    assert [c.tried for c in counted] == [0, 0, 0, 0]
    held = [
        ("address", "7 High Street, Leeds LS1 4AB"), ("address", "12a Mill Lane, York"), ("address", "12 bis, rue de la Paix, 75002 Paris"), ("address", "3, avenue Foch, 69006 Lyon"), ("address", "Lindenstraße 5 a, 10969 Berlin"),
        ("phone", "+44 20 7946 0958"), ("phone", "0049 30 1234567"), ("phone", "030/12345678"), ("phone", "(020) 7946 0958"), ("phone", "555-123-4567"),
        ("id_number", "123-45-6789"), ("id_number", "1 84 12 76 451 089 46"), ("id_number", "12 34 567 890 123"), ("id_number", "12345678A123"),
    ]
    for kind, value in held:
        text = f"so it is: {value}; and on"
        assert [(k, text[a:b]) for k, a, b in finder.find(text)] == [(kind, value)], value
