import math

import pytest
from pyspark.sql import functions as F

from tessellex.functions import probability as p
from tessellex.functions import stemmers, text
from tessellex.operators import alignment, statistics, vocabulary


def test_probabilities():
    assert p.t_two_sided(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert p.mcnemar(206, 133) == (pytest.approx(15.2920354), pytest.approx(9.2104e-05, rel=1e-4), False)
    assert p.mcnemar(3, 1) == (1.0, pytest.approx(0.625), True)
    assert p.wilcoxon([*range(1, 11)]) == (0.0, 2 / 1024)
    assert p.wilcoxon([0, 0]) == (0.0, 1.0)
    assert p.spearman_p(-0.1956, 14) == pytest.approx(0.5028, abs=1e-4)
    assert p.midranks([3, 1, 3]) == [2.5, 1.0, 2.5] and p.midranks([]) == []
    assert p.t_two_sided(0.7, 1) == pytest.approx(1 - 2 / math.pi * math.atan(0.7), rel=1e-12)
    assert p.t_two_sided(50.0, 2) == pytest.approx(1 - 50 / math.sqrt(2 + 2500), rel=1e-9)
    assert p.t_two_sided(1.959963984540054, 1e7) == pytest.approx(0.05, rel=1e-5) and p.t_two_sided(0.0, 3) == 1.0
    # published two-sided 95 % quantiles
    assert [round(p.t_quantile(df), 3) for df in (1, 2, 3, 4, 5, 9, 14, 30, 120)] == [12.706, 4.303, 3.182, 2.776, 2.571, 2.262, 2.145, 2.042, 1.98]
    assert p.spearman_p(0.705, 14) == pytest.approx(0.0048, abs=1e-4)


@pytest.mark.parametrize(("word", "stem"), [("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("controll", "control"), ("adoption", "adopt")])
def test_porter(word, stem):
    assert stemmers.porter(word) == stem


@pytest.mark.parametrize(("word", "stem"), [("häuser", "haus"), ("kategorischen", "kategor"), ("ergebnisse", "ergebnis")])
def test_german(word, stem):
    assert stemmers.german(word) == stem


@pytest.mark.parametrize(("word", "stem"), [("consignment", "consign"), ("knightly", "knight"), ("generously", "generous"), ("consistency", "consist"), ("skies", "sky"), ("ties", "tie")])
def test_english(word, stem):
    assert stemmers.english(word) == stem


@pytest.mark.parametrize(("word", "stem"), [("chicharrones", "chicharron"), ("chicas", "chic"), ("torneando", "torn"), ("torneos", "torne"), ("torturando", "tortur")])
def test_spanish(word, stem):
    assert stemmers.spanish(word) == stem


#: Words and their stems, from the samples that the algorithms' pages show.
PUBLISHED = {
    "fr": """
        continu continu continua continu continuait continu continuant continu continuation continu continue continu continué continu continuel continuel
        continuelle continuel continuellement continuel continuera continu continuité continu continuons continuon contorsions contors contour contour
        contournait contourn contractait contract contracté contract contractions contract contradictoirement contradictoir contraindre contraindr contrainte
        contraint contraires contrair contraria contrari maintenant mainten maintenue maintenu mairie mair maïs maï maîtresse maîtress majesté majest
        majestueuse majestu majestueusement majestu majeur majeur majorités major malades malad maladive malad
    """,
    "it": """
        abbandonata abbandon abbandonate abbandon abbandonati abbandon abbandonato abbandon abbandonava abbandon abbandonerà abbandon abbandoneranno abbandon
        abbandonerò abbandon abbandono abband abbandonò abbandon abbaruffato abbaruff abbassamento abbass abbassando abbass abbassandola abbass abbassandole
        abbass abbassar abbass abbassare abbass abbassarono abbass abbassarsi abbass abbassassero abbass abbassato abbass abbassava abbass abbassi abbass
        abbassò abbass abbastanza abbast abbatté abbatt abbattendo abbatt abbattere abbatt abbattersi abbatt abbattesse abbattess abbatteva abbatt
        abbattimento abbatt abbattuta abbatt abbellita abbell abbenché abbenc
    """,
    "pt": """
        boa boa boas boas bôas bôas boassu boassu boataria boat boate boat boates boat boatos boat bob bob boba bob bobagem bobag bobagens bobagens bobalhões
        bobalhõ bobear bob bobeira bobeir bobinho bobinh bobinhos bobinh bobo bob bobs bobs boca boc bocadas boc bocadinho bocadinh bocado boc bocaiúva
        bocaiúv boçal boçal bocarra bocarr bocas boc bode bod bodoque bodoqu body body boeing boeing boem boem boemia boem boêmio boêmi bogotá bogot boi boi
        boiando boi
    """,
    "sv": """
        jakt jakt jaktbössa jaktböss jakten jakt jakthund jakthund jaktkarl jaktkarl jaktkarlar jaktkarl jaktkarlarne jaktkarl jaktkarlens jaktkarl
        jaktlöjtnant jaktlöjtnant jaktlöjtnanten jaktlöjtnant jaktlöjtnantens jaktlöjtnant jalusi jalusi jalusien jalusi jalusier jalusi jalusierna jalusi
        jamade jam jamas jam kastade kast kastar kast katten katt klockor klock
    """,
    "no": """
        havnedistrikt havnedistrikt havnedistriktene havnedistrikt havnedistrikter havnedistrikt havnedistriktet havnedistrikt havnedistriktets havnedistrikt
        havnedrift havnedrift havnedriften havnedrift havneeffektivitet havneeffektivit havneeier havneei havneenheter havneen havneforbund havneforbund
        havneforbundets havneforbund havneformål havneformål havneforvaltningen havneforvaltning havnefunksjonene havnefunksjon havnefunksjoner havnefunksjon
        havnefylkene havnefylk
    """,
    "da": """
        indtage indtag indtagelse indtag indtager indtag indtages indtag indtaget indtag indtil indtil indtog indtog indtraf indtraf indtryk indtryk indtræde
        indtræd indtræder indtræd indtræffe indtræf indtræffer indtræf indtrængende indtræng indtægt indtæg indtægter indtæg indvandrede indvandred indvandret
        indvandr uforsigtig uforsig uforskammet uforskam
    """,
    "nl": """
        lichaamsziek lichaamsziek lichamelijk licham lichamelijke licham lichamelijkheden licham lichamen licham lichere licher licht licht lichte licht
        lichten licht lichtende lichtend lichter lichter opgingen opging opglimpen opglimp opgroeien opgroei opheffen opheff ophelderen ophelder ophield
        ophield opheldering ophelder
    """,
    "ru": """
        вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоне вагон вагонов вагон вагоном вагон вагоны вагон важная важн важнее важн важнейшие
        важн важнейшими важн важничал важнича важно важн важного важн важное важн важной важн важном важн важному важн важности важност важностию важност
        важность важност важностью важност важную важн важны важн важный важн важным важн важных важн вазах ваз вазы ваз вакса вакс вакханка вакханк
        павильонам павильон
    """,
}


@pytest.mark.parametrize("lang", sorted(PUBLISHED))
def test_published_stems(lang):
    words = PUBLISHED[lang].split()
    assert len(words) >= 30
    assert [(w, stemmers.BY_LANGUAGE[lang](w)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))


@pytest.mark.parametrize(("lang", "words"), [("fi", "edeltäjien edeltäj edeltäjiinsä edeltäj edeltäjän edeltäj edeltäjät edeltäj edeltävien edeltäv edeltävän edeltäv"), ("ro", "abruptă abrupt absent absent absentă absent absente absent absenţa absenţ absenţă absenţ absenţi absenţ absolve absolv absolvenţi absolvenţ absolvenţii absolvenţ absolvi absolv absolvire absolv absolvit absolv absolviţi absolv absorbant absorb absorbantă absorb absorbi absorb absorbit absorb absorbite absorb absorbiţi absorb absorbţia absorbţ"), ("hu", "babakocsit babakocs babakocsijáért babakocs babérjaikra babér babért bab")])
def test_stems_by_definition(lang, words):
    words = words.split()
    assert [stemmers.BY_LANGUAGE[lang](w) for w in words[::2]] == words[1::2]


def test_stemmers_take_any_word_and_code():
    odd = ["", "a", "ab", "'", "ß", "é", "yyy", "bbb", "ая", "ünk", "x" * 300, "кк", "12", "ééé", "qu"]
    assert all(isinstance(f(w), str) for f in stemmers.BY_LANGUAGE.values() for w in odd)
    assert stemmers.stemmer_of("fra_Latn") is stemmers.stemmer_of("fr-CA") is stemmers.stemmer_of("fr") and stemmers.stemmer_of("ben_Beng") is stemmers.stemmer_of(None) is None


def test_orthography():
    assert text.orthographic("  Été, İI x!") == "ete ii x"
    assert text.orthographic("İI", turkish=True) == "iı"
    assert text.orthographic(None) == text.orthographic("") == ""
    assert text.orthographic("कि") == "कि"  # vowel signs are no combining marks of a class


@pytest.mark.parametrize("punctuation", ["narrow", "wide"])
def test_ortho_is_one_function_on_both_paths(spark, punctuation):
    """Plain texts in the JVM and the others through the Unicode tables give what the function of one text gives."""
    texts = [None, "", " A b\tC\x1cd ", "ÀÉÎÕÜ ÿß æø «x» ¿y? ¡z!", "İI ıi", "ﬁne ½ µ ª", "日本。、", "naïve\u0301 e\u0301", "Σας", "x\u00a0y", "ТЕСТ Ёж", "!?", "tab\x85nel"]
    rows = [(i, t, la) for i, (t, la) in enumerate((t, la) for t in texts for la in ("en", "tr", "tur_Latn", None))]
    d = spark.createDataFrame(rows, "i int, t string, lang string")
    want = {i: text.orthographic(t, punctuation, bool(la) and la.startswith(("tr", "tur"))) for i, t, la in rows}
    assert {r.i: r.x for r in d.select("i", text.ortho(F.col("t"), punctuation, F.col("lang")).alias("x")).collect()} == want
    plain = {i: text.orthographic(t, punctuation) for i, t, _ in rows}
    assert {r.i: r.x for r in d.select("i", text.ortho(F.col("t"), punctuation).alias("x")).collect()} == plain


def test_tokens(spark):
    d = spark.createDataFrame([(" a b　c\x1cd​ ",), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(text.tokenize(F.col("t"))).collect()] == [["a", "b", "c", "d​"], [], []]
    assert d.select(text.edge_stripped(F.lit("«Ab-c!» -- x"))).head()[0] == ["Ab-c", "x"]
    assert d.select(text.sentences(F.lit("A b. C? "))).head()[0] == ["A b.", "C?"]


def test_scores(spark):
    one = spark.range(1)
    cr, irs = F.lit(2.0115260), F.lit(0.8532054)
    assert one.select(vocabulary.aes(irs, vocabulary.vrg(cr))).head()[0] == pytest.approx(0.63278, abs=1e-5)
    assert one.select(vocabulary.vrg(F.lit(0.5)), vocabulary.vrg(F.lit(0.5), clamped=False)).head() == (0.0, -1.0)


def test_identity_has_no_divergence(spark):
    d = spark.createDataFrame([("a b a",), ("c",)], "t string").select(F.lit(1).alias("k"), text.tokenize(F.col("t")).alias("x"))
    t = vocabulary.exploded(d, ["k"], raw=F.col("x"), norm=F.col("x"))
    assert vocabulary.kl_divergence(t, ["k"], "raw", "norm").head().kl == pytest.approx(0)
    assert vocabulary.vocabulary(t, ["k"], ["raw", "norm"]).head()[1:] == (3, 3)


def test_anld(spark):
    d = spark.createDataFrame([(0, ["ab", "cd"], ["ax"])], "doc_id long, raw array<string>, norm array<string>")
    assert alignment.anld(alignment.align(d, padded=True), []).head().anld == pytest.approx(0.75)
    assert alignment.anld(alignment.align(d, padded=False), []).head().anld == pytest.approx(0.5)


def test_holm(spark):
    d = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "i int, p double").withColumn("g", F.lit(0))
    got = {r.i: r.p_holm for r in statistics.holm(d, ["g"], "p").collect()}
    assert [round(got[i], 9) for i in (1, 2, 3)] == [0.03, 0.06, 0.06]


def test_paired(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0)], "a double, b double")
    r = statistics.paired(d, [], "a", "b").head()
    assert (r.delta, r.sd) == (1.5, pytest.approx(math.sqrt(0.5)))
    assert (r.lo, r.hi) == (pytest.approx(1.5 - 12.706205 / 2, abs=1e-5), pytest.approx(1.5 + 12.706205 / 2, abs=1e-5))
