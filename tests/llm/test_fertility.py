import math
import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pytest

from lakeworks.llm import fertility as X
from lakeworks.llm import queries

from .fixtures import SCHEMA, awkward, awkward_rows, texts_of


def slow_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, again = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            again |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(again), failed


def rows_of(df):
    return sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in df.collect()), key=str)


def test_awkward_rows_as_brute_force(spark):
    got = X.measures(awkward(spark), queries.RANKS, queries.PATTERN, queries.PIECES)
    assert rows_of(got) == sorted(((r[0], *slow_base(r[1])) for r in awkward_rows()), key=str)
    assert not got.filter("kept and base_failed").count()


def test_whole_table_as_brute_force(spark, sf):
    got = queries.QUERIES["op5_fertility"](spark, sf)
    assert rows_of(got) == sorted(((i, *slow_base(t)) for i, t in texts_of(sf, columns="doc_id, text")), key=str)


def test_bands_keep_good_and_reject_junk(spark, sf):
    quality = dict(texts_of(sf.replace("0.001", "0.01"), "labels", "doc_id, quality"))
    got = queries.QUERIES["op5_fertility"](spark, sf.replace("0.001", "0.01")).filter("not base_failed").collect()
    good = [r["kept"] for r in got if quality.get(r["doc_id"]) == 1]
    junk = [r["kept"] for r in got if quality.get(r["doc_id"]) == 0]
    assert all(good) and len(good) > 100
    assert sum(junk) < 0.6 * len(junk)


@pytest.fixture(scope="module")
def vocabularies():
    return X.Fertility(queries.RANKS, queries.PATTERN, queries.PIECES)


def test_words_cut_together_as_cut_alone(vocabularies):
    words = ["the", "naïve", "漢字", "don't", "\x1c", "a\xa0b", "\x85", "!!", "ééé", "x" * 200]
    for some in (words, [w for w in words if w != "a\xa0b"], []):
        ids, lengths = vocabularies.merged(some)
        pieces, raw = vocabularies.pieced(some)
        ends = lengths.cumsum()
        for i, w in enumerate(some):
            assert ids[ends[i] - lengths[i] : ends[i]].tolist() == vocabularies.merges.encode_ordinary(" " + w)
            own = vocabularies.pieces.encode(w)
            assert (pieces[i], raw[i]) == (len(own), sum(vocabularies.pieces.is_byte(k) for k in own))


def test_measures_by_brute_force(vocabularies):
    """Token by token, for texts of one block that share words."""
    rng = random.Random(2)
    vocabulary = ["the", "naïve", "漢字", "don't", "#tag", "ééé", "x" * 30, "A|B", "mot", "слово", "ẹ̀tọ́", "12", "\x1c", "a\xa0b"]
    texts = [" ".join(rng.choice(vocabulary[: rng.randrange(1, 15)]) for _ in range(rng.randrange(0, 300))) for _ in range(40)] + ["", "one", "a b c", "a b a b a b"]
    found = X.judge(texts, vocabularies)
    for i, text in enumerate(texts):
        words = text.split(" ") if text else []
        tokens = Counter(t for w in words for t in vocabularies.merges.encode_ordinary(" " + w))
        pieces = [p for w in words for p in vocabularies.pieces.encode(w)]
        n = tokens.total()
        spread = -sum(k / n * math.log2(k / n) for k in tokens.values()) / math.log2(min(n, X.LENGTH_FOR_ENTROPY)) if n > 1 else 0.0
        assert found["token_entropy"][i] == pytest.approx(spread, abs=1e-9)
        assert found["chars_per_token"][i] == pytest.approx(sum(map(len, words)) / n if n else 0.0)
        assert found["fallback_share"][i] == pytest.approx(sum(map(vocabularies.pieces.is_byte, pieces)) / len(pieces) if pieces else 0.0)
        assert tuple(found[c][i] for c in list(X.COLUMNS)[:6]) == slow_base(text)
        assert found["script"][i] == (X.main_script(np.bincount([X.script_of(w) for w in words])) if words else "other")


def test_scripts_and_measures(vocabularies):
    english = "The quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree nearby. "
    varied = " ".join(f"{w}{i % 7}" if i % 11 == 0 else w for i, w in enumerate((english * 5).split()))
    russian = "Съешь ещё этих мягких французских булок, да выпей чаю. "
    found = X.judge([varied, russian, "漢字 漢 かな", "", "12 34", "\U000e0041 \U000e0042"], vocabularies)
    assert found["script"] == ["latin", "cyrillic", "han", "other", "other", "other"]
    assert found["fallback_share"][0] == 0 and found["fallback_share"][5] > 0.5
    assert found["chars_per_token"][0] > 2.5 and found["chars_per_token"][3] == 0
    assert not found["kept"][3]


def test_stage_returns_whole_rows(spark):
    docs = awkward(spark)
    kept = X.passing(docs, queries.RANKS, queries.PATTERN, queries.PIECES)
    want = X.measures(docs, queries.RANKS, queries.PATTERN, queries.PIECES).filter("kept")
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in want.collect())


def test_empty_table(spark):
    assert X.measures(spark.createDataFrame([], SCHEMA), queries.RANKS, queries.PATTERN, queries.PIECES).collect() == []


# The first articles of the Human Rights declaration.
DECLARATION = {
    "yo": ("latin_marked", "Gbogbo ènìyàn ni a bí ní òmìnira; iyì àti ẹ̀tọ́ kọ̀ọ̀kan sì dọ́gba. Wọ́n ní ẹ̀bùn ti làákàyè àti ti ẹ̀rí-ọkàn, ó sì yẹ kí wọn ó máa hùwà sí ara wọn gẹ́gẹ́ bí ọmọ ìyá. Ẹnì kọ̀ọ̀kan ló ní àǹfàní sí gbogbo ẹ̀tọ́ àti òmìnira tí a ti gbé kalẹ̀ nínú ìkéde yìí láìfi ti ọ̀rọ̀ ìyàtọ̀ ẹ̀yà kankan ṣe; ìyàtọ̀ bí i ti ẹ̀yà ènìyàn, àwọ̀, akọ-n̄-bábo, èdè, ẹ̀sìn, ètò ìṣèlú tàbí ìyàtọ̀ nípa èrò ẹni."),
    "vi": ("latin_marked", "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Ai cũng được hưởng những quyền tự do ghi trong bản Tuyên ngôn này không phân biệt đối xử vì bất cứ lý do nào, như chủng tộc, màu da, nam nữ, ngôn ngữ, tôn giáo, chính kiến hay quan niệm."),
    "am": ("unlisted", "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው። የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል። እያንዳንዱ ሰው የዘር የቀለም የጾታ የቋንቋ የሃይማኖት የፖለቲካ ወይም የሌላ ዓይነት አስተሳሰብ የብሔራዊ ወይም የኅብረተሰብ ታሪክ የሀብት የትውልድ ወይም የሌላ ደረጃ ልዩነት ሳይኖሩ በዚሁ ውሳኔ የተዘረዘሩት መብቶችንና ነጻነቶች ሁሉ እንዲከበሩለት ይገባል። እያንዳንዱ ሰው የመኖር፣ በነጻነትና በሰላም የመኖር መብት አለው።"),
    "ka": ("unlisted", "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით. ყოველ ადამიანს უნდა ჰქონდეს ამ დეკლარაციით გამოცხადებული ყველა უფლება და ყველა თავისუფლება, განურჩევლად რაიმე განსხვავებისა, სახელდობრ რასის, კანის ფერის, სქესის, ენის, რელიგიის, პოლიტიკური თუ სხვა რწმენის, ეროვნული თუ სოციალური წარმოშობის, ქონებრივი, წოდებრივი თუ სხვა მდგომარეობისა."),
    "cs": ("latin", "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Každý má všechna práva a všechny svobody, stanovené touto deklarací, bez jakéhokoli rozlišování, zejména podle rasy, barvy, pohlaví, jazyka, náboženství, politického nebo jiného smýšlení, národnostního nebo sociálního původu, majetku, rodu nebo jiného postavení."),
}


@pytest.mark.parametrize("form", ["NFC", "NFD"])
@pytest.mark.parametrize("lang", DECLARATION)
def test_clean_text_of_other_languages_is_kept(vocabularies, lang, form):
    script, text = DECLARATION[lang]
    found = X.judge([unicodedata.normalize(form, text)], vocabularies)
    assert found["kept"] == [True], {c: v[0] for c, v in found.items()}
    assert form == "NFD" or found["script"] == [script]
