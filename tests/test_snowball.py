"""Snowball stems of published word pairs."""

from tessella.operators import snowball as S

# Words and stems from the algorithm's published sample vocabulary.
PAIRS = """в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоне вагон вагонов вагон вагоном вагон вагоны вагон важная важн важнее важн важнейшие важн важнейшими важн важничал важнича важно важн важного важн важное важн
важной важн важном важн важному важн важности важност важностию важност важность важност важностью важност важную важн важны важн важные важн важный важн важным важн важных важн вазах ваз вазы ваз вакса вакс вакханка вакханк вал вал
валандался валанда валентина валентин валериановых валерианов валерию валер валетами валет п п па па пава пав павел павел павильон павильон павильонам павильон павла павл павлиний павлин павлиньи павлин павлиньим павлин павлович павлович
павловна павловн павловне павловн павловной павловн павловну павловн павловны павловн павловцы павловц павлыч павлыч павлыча павлыч пагубная пагубн падает пада падай пада падал пада падала пада падаль падал падать пада падаю пада падают пада
падающего пада падающее пада падающей пада падающие пада паденье паден паденья паден падет падет падут падут падучая падуч падчерицей падчериц падчерицы падчериц падшая падш падшей падш падшему падш падший падш падшим падш падших падш падшую падш""".split()


def test_published_pairs(spark):
    words, stems = PAIRS[::2], PAIRS[1::2]
    got = {r["word"]: r["stem"] for r in S.stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    wrong = {w: (got[w], s) for w, s in zip(words, stems, strict=True) if got[w] != s}
    assert not wrong


def test_codes_nulls_and_clashing_columns(spark):
    rows = [("ввгнг-5", 1), ("17.25", 2), ("house", 3), (None, 4), ("", 5), ("ёлки", 6), ("вьюга1", 7)]
    got = {r["n"]: (r["stem"], r["_x"]) for r in S.stems(spark.createDataFrame([(*r, "x") for r in rows], "word string, n int, _x string")).collect()}
    assert got == {1: ("ввгнг-5", "x"), 2: ("17.25", "x"), 3: ("house", "x"), 4: (None, "x"), 5: ("", "x"), 6: ("елк", "x"), 7: ("вьюга1", "x")}
