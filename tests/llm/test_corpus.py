"""Token ids, leaked items and junk pages."""

import base64
import random

import numpy as np
import pytest

from proofloom.llm import leakage, spam, tokens
from tests.conftest import rows

RANKS = f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def bpe():
    with open(RANKS, "rb") as f:
        return tokens.Bpe.load(f.read())


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_every_token_encodes_to_itself(bpe):
    assert [w for w, r in bpe.ranks.items() if bpe.merge(w) != [r]] == []


def test_ids_against_the_library(bpe, reference):
    rng = random.Random(1)
    odd = [chr(i) for i in [*range(0x250), 0x85, 0x1680, 0x180E, 0x200B, 0x2028, 0x3000, 0xFEFF, 0x301, 0x4E00, 0x3042, 0x1F600]]
    texts = ["", "<|endoftext|> a  b\n\n c", "   ", "It's 12.5 μM; the α-catex's", "x" * 3000 + " " * 500]
    for _ in range(3000):
        texts.append("".join(rng.choice(odd if rng.random() < 0.3 else list("abcdeinorst 'S\n1")) for _ in range(rng.randrange(40))))
    assert bpe.encode(texts) == [reference(t) for t in texts]


def test_compatible_pairs_are_those_that_merging_keeps(bpe):
    rng = np.random.default_rng(2)
    words = {r: w for w, r in bpe.ranks.items()}
    a, b = rng.integers(0, 50_000, 4000), rng.integers(0, 50_000, 4000)
    near = rng.integers(0, 1000, 2000)
    a, b = np.concatenate([a, near]), np.concatenate([b, rng.integers(0, 1000, 2000)])
    want = [bpe.merge(words[x] + words[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]
    assert bpe.compatible(a, b).tolist() == want


def test_corpus_has_a_row_for_every_document(spark):
    df = spark.createDataFrame([(1, "Hello world", 0), (2, None, 0), (3, "", 0), (None, "a", 0), (1, "Hello world", 0)], "doc_id long, text string, ids int")
    got = tokens.encode_corpus(df)
    assert dict(got.dtypes)["ids"] == "array<int>"
    assert sorted((r["doc_id"] or 0, tuple(r["ids"])) for r in got.collect()) == [(0, (64,)), (1, (15496, 995)), (1, (15496, 995)), (2, ()), (3, ())]
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_forgetting_words_changes_nothing(bpe, reference, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 5)
    monkeypatch.setattr(tokens, "REMEMBER_BYTES", 4)
    texts = ["alpha beta gamma delta epsilon zeta", "beta gamma eta theta iota kappa", "alpha beta"]
    for t in texts:
        assert bpe.encode([t, None]) == [reference(t), []]


def test_alignment():
    ids = lambda s: np.array([ord(c) for c in s])
    assert leakage.local_alignment(ids("xxabcdexx"), ids("abcde")) == (10, 5)
    assert leakage.local_alignment(ids("abXcde"), ids("abcde")) == (8, 3)
    assert leakage.local_alignment(ids("xyz"), ids("abc")) == (0, 0)
    assert leakage.local_alignment(ids(""), ids("abc")) == (0, 0)


def _words(rng, n):
    return [rng.choice(["the", "of", "in", "cells", "with"]) if rng.random() < 0.5 else f"v{rng.randrange(300)}" for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    items = [(100 + i, _words(rng, rng.choice([3, 14, 15, 16, 30, 60]))) for i in range(25)]
    docs = []
    for i in range(80):
        w = _words(rng, rng.randrange(60))
        if rng.random() < 0.7:
            _, it = rng.choice(items)
            n = rng.choice([14, 15, 16, 40])
            s = rng.randrange(max(1, len(it) - n + 1))
            at = rng.randrange(len(w) + 1)
            w[at:at] = it[s : s + n]
        docs.append((i, rng.choice([" ", ",\n", " - "]).join(w).upper()))
    docs += [(90, None), (91, ""), (92, " ".join(_words(rng, 30_000) + items[-1][1])), (None, " ".join(items[0][1])), docs[3]]
    text = [(i, " ".join(w)) for i, w in items] + [(1, None), (2, ""), (None, "a b c d e f g h i j k l m n o p")]
    from proofloom.functions.text import words_of

    grams = {i: {tuple(w[s : s + 15]) for s in range(len(w) - 14)} for i, w in ((i, words_of(t)) for i, t in text if i)}
    want = set()
    for d, t in docs:
        w = words_of(t)
        mine = {tuple(w[s : s + 15]) for s in range(len(w) - 14)}
        want |= {(d, i) for i, g in grams.items() if d is not None and g & mine}
    a = spark.createDataFrame([(*d, 1) for d in docs], "id long, text string, doc_id int")
    b = spark.createDataFrame([(*t, 1) for t in text], "id long, text string, item_id int")
    got = leakage.leaks(a, b)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect() if r["run"] >= 15} == want and want
    assert leakage.leaks(a.limit(0), b).count() == 0 and leakage.leaks(a, b.limit(0)).count() == 0


def _edit(rng, words, rate, pool):
    out = []
    for w in words:
        if rng.random() >= rate:
            out.append(w)
        elif (how := rng.random()) < 0.6:
            out.append(rng.choice(pool))
        elif how > 0.8:
            out += [w, rng.choice(pool)]
    return out


def test_edited_copies_are_found(spark):
    rng = random.Random(6)
    items = [(i, _words(rng, rng.choice([20, 25, 35, 60]))) for i in range(120)]
    docs = [(1000 * r + i, _words(rng, 40) + _edit(rng, w, r / 100, w) + _words(rng, 40)) for r in (0, 5, 10, 15, 20) for i, w in items]
    docs += [(900_000 + i, _words(rng, 120)) for i in range(60)]
    a = spark.createDataFrame([(i, " ".join(w)) for i, w in docs] + [(-1, None), (-2, ""), (None, "a b c")], "id long, text string")
    b = spark.createDataFrame([(i, ", ".join(w).upper(), 1) for i, w in items] + [(-1, None, 1), (-2, "", 1), (None, "a b c d", 1)], "id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.edited_leaks(a, b).collect()}
    for r in (0, 5, 10, 15, 20):
        assert sum((1000 * r + i, i) in got for i, _ in items) >= 0.9 * len(items), r
    assert not any(d >= 900_000 for d, _ in got) and all(d % 1000 == i for d, i in got)
    assert leakage.edited_leaks(a.limit(0), b).count() == 0 and leakage.edited_leaks(a, b.limit(0)).count() == 0


def test_items_are_sought_in_blocks(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, " ".join(_words(rng, 30))) for i in range(7)]
    df = spark.createDataFrame(items, "id long, text string")
    want = rows(leakage.edited_leaks(df, df))
    monkeypatch.setattr(leakage, "ITEM_BLOCK", 2)
    assert rows(leakage.edited_leaks(df, df)) == want and len(want) == 7


def test_suffix_automaton_cover_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        t = [rng.randrange(3) for _ in range(rng.randrange(25))]
        least, times = rng.choice([(1, 2), (2, 2), (2, 3), (3, 2)])
        want = [False] * len(t)
        for i in range(len(t)):
            for j in range(i + least, len(t) + 1):
                if sum(t[k : k + j - i] == t[i:j] for k in range(len(t))) >= times:
                    want[i:j] = [True] * (j - i)
        assert spam.SuffixAutomaton(t).covered(t, least, times) == want, t


ARTICLE = "We next asked how the protein reaches the membrane in starved cells. Mice received 27 mg of the drug by gavage for 3 weeks. These data place it between the relay and the brake, although levels stayed flat in the controls. "
JUNK = [
    "buy KIT1 antibody; cheap KIT1 antibody online; " * 20,
    " | ".join(f"https://www.shop{i}.example/item/k{i}" for i in range(30)),
    "\n".join(f"[ABC{i} kit](https://lab{i}.test/{i})" for i in range(30)),
    " ".join(f"#tag{i % 4} #sale #DRT{i}" for i in range(30)),
    "In stock ADD TO CART " + "Related: drug kit $45 ADD TO CART In stock " * 15,
    "The brake was fixed for 4 min. " + "assay inhibitor KIT1 order now kinase kit assay " * 20,
    " / ".join(f"recombinant ABC{i} / ABC{i} lysate / anti-ABC{i} pAb" for i in range(20)),
]
SOUND = [
    ARTICLE * 2,
    ARTICLE + "References\n" + "\n".join(f"{i}. Smith et al. ABC{i} in tissue. J Sci Res 20{i + 10}." for i in range(4)),
    ARTICLE * 2 + "The panel held " + ", ".join(f"ABC{i}B" for i in range(25)) + ".",
    ARTICLE + "Data are at https://a.test/1 and https://b.test/2 and in the supplement.",
    "この効果は活性に依存しない。" * 10,
    "Dans les cellules, le facteur active la voie après 53 minutes. Cet effet dépend de la voie et non du signal. " * 2,
]


@pytest.mark.parametrize("text", JUNK)
def test_junk_pages(text):
    assert spam.junk_share(text) > spam.SHARE


@pytest.mark.parametrize("text", SOUND)
def test_sound_pages(text):
    assert spam.junk_share(text) <= spam.SHARE


def test_half_junk_is_no_case():
    assert spam.junk_share(ARTICLE * 2 + "\n" + "buy KIT1 antibody; cheap KIT1 antibody online; " * 9) <= spam.SHARE


def test_half_junk_has_its_share():
    assert 0.2 < spam.junk_share(ARTICLE * 2 + "\n" + "buy KIT1 antibody; cheap KIT1 antibody online; " * 9) < 0.6


def _goods(n):
    made = [f"{a} {b} {c}" for a in "Blue Red Green Soft Large Nordic Slim Royal".split() for b in "Cotton Leather Steel Oak Linen".split() for c in "Shirt Boots Lamp Chair".split()]
    random.Random(1).shuffle(made)
    return made[:n]


def _orders(goods, times):
    rng = random.Random(2)
    return " ".join(" ".join(rng.sample(goods, len(goods))) for _ in range(times))


@pytest.mark.parametrize("text", [
    "ラーメン 東京 安い おすすめ " * 60,
    "手机 电脑 便宜 优惠 " * 50,
    "Kaufen Sie jetzt den besten Kit für wenig Geld\n" * 60,
    "Shop for the best kinase kit with free shipping " * 60,
    _orders(_goods(80), 6),
    "\n".join(_goods(80)),
    ", ".join(_goods(80)).lower(),
    "купить кит дешево онлайн кит цена " * 30,
])
def test_junk_pages_of_kinds_and_languages_not_in_the_tables(text):
    assert spam.junk_share(text) > spam.SHARE


@pytest.mark.parametrize("text", [
    "研究表明该蛋白在细胞膜上与受体结合，从而激活下游信号通路。我们进一步检测了其在不同组织中的表达水平。结果显示其在肝脏中表达最高。",
    "Мы показали, что белок связывается с рецептором на мембране клетки и активирует путь. Это не зависит от уровня сигнала в ткани.",
    "Tutkimuksessa havaittiin proteiinin sitoutuvan solukalvon reseptoriin. Tämä aktivoi solunsisäisen signaalireitin useissa kudoksissa.",
    "이 단백질은 세포막의 수용체에 결합하여 신호 경로를 활성화한다. 우리는 다양한 조직에서 발현 수준을 측정하였다.",
    "Abbiamo osservato che la proteina si lega al recettore della membrana. Questo effetto non dipende dal livello del segnale.",
    "أظهرت الدراسة أن البروتين يرتبط بالمستقبل على سطح الخلية. هذا التأثير لا يعتمد على مستوى الإشارة في النسيج.",
    "we next asked how the protein reaches the membrane\nin starved cells and whether the drug blocks it when\nlevels stay flat in the controls or rise with time",
])
def test_sound_pages_of_languages_not_in_the_tables(text):
    assert spam.junk_share(text) <= spam.SHARE


def test_junk_rows(spark):
    df = spark.createDataFrame([(1, JUNK[0], 9), (2, None, 9), (3, "", 9), (4, " \n", 9), (5, "buy now", 9), (6, ARTICLE, 9), (7, "kit price " * 20_000, 9)], "doc_id long, text string, words int")
    got = {r["doc_id"]: (r["words"], r["junk"] > spam.SHARE) for r in spam.junk_pages(df).collect()}
    assert {k for k, (w, j) in got.items() if j and w >= spam.LEAST_WORDS} == {1, 7} and got[2] == (0, False) and got[4] == (0, False)
    assert rows(spam.junk_pages(df.limit(0))) == []
