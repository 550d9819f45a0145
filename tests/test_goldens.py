"""Derived values recomputed from published ones, to 1e-9: scores, ratios, intervals, tests and rank correlations."""

import pytest
from pyspark.sql import functions as F

from tessellex.functions import probability
from tessellex.operators import statistics
from tessellex.operators import vocabulary as vo

# Published results, each table in its own order.
#: cr, vrg, irs and the scores for betas 0.25, 0.5, 0.75, 1, 1.5, 2 and 4
SCORES = [
    (2.011526048870447, 0.5028650011460005, 0.8532053828239441, 0.8196161284720948, 0.748860805344798, 0.6821234118573706, 0.6327800251126873, 0.5755866971964408, 0.547856834627653, 0.5153118031379799),
    (2.0274163568773234, 0.506761402704561, 0.8721210360527039, 0.8366391814916657, 0.7622143418958426, 0.6924073331437257, 0.6410369254634105, 0.5817503174977321, 0.5531040262336901, 0.5195650834500543),
    (1.6819583654587509, 0.40545496218198485, 0.9430338144302368, 0.874805864771895, 0.7453792492304158, 0.6383445219470746, 0.5670907258519917, 0.4916994317749318, 0.45762954172062004, 0.4195226057586127),
    (1.9538737124944021, 0.48819619527847813, 0.9371691346168518, 0.8890725691363462, 0.7915738783271916, 0.704068606979862, 0.6419721263824602, 0.5726018572745106, 0.5399293707930994, 0.5023529002569894),
]
BETAS = (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 4.0)
#: n, mean, standard deviation, ends of the interval and d_z of paired differences; discordant counts, statistic, p and exactness
PAIRED = [
    (10, -0.01977736226778275, 0.017069439089113157, -0.03198810340122546, -0.007566621134340042, -1.1586416029567546, 206, 133, 15.29203539823009, 9.210403405089094e-05, False),
    (10, -0.020398785160182665, 0.01613316633522242, -0.03193975711325746, -0.008857813207107868, -1.2644005978942532, 208, 133, 16.058651026392962, 6.14104177728248e-05, False),
    (10, -0.02534966110014917, 0.015570532471317896, -0.036488149033146906, -0.014211173167151432, -1.6280535779264564, 225, 133, 23.131284916201118, 1.5130871581145995e-06, False),
    (10, 0.003927917809752745, 0.015641446814208815, -0.007261299188164382, 0.015117134807669873, 0.25112240935311647, 142, 156, 0.5671140939597316, 0.4514079828609113, False),
    (10, -0.012410875874150051, 0.011229639081391036, -0.0204440757425812, -0.0043776760057189015, -1.1051892036954667, 113, 62, 14.285714285714286, 0.00015705228423075143, False),
    (10, 0.003622935389455628, 0.010305788036505463, -0.0037493812539284117, 0.010995252032839669, 0.35154375159108264, 71, 86, 1.2484076433121019, 0.2638568268292288, False),
    (10, -0.00935205490543738, 0.013667772352425969, -0.019129390246980214, 0.00042528043610545394, -0.6842413426484553, 428, 345, 8.698576972833118, 0.003184585666469713, False),
    (10, -0.01139599789699034, 0.015421960551508327, -0.02242820388111898, -0.00036379191286169815, -0.7389461190053276, 501, 413, 8.281181619256017, 0.0040058052487445175, False),
    (10, -0.03081487306031631, 0.03749835389083259, -0.05763957947865535, -0.003990166641977273, -0.8217660207172394, 343, 265, 9.751644736842104, 0.001791623457109495, False),
    (10, -0.047607816208305904, 0.03270309203747612, -0.0710021989439087, -0.024213433472703105, -1.455758866890926, 359, 242, 22.389351081530783, 2.2260485269180893e-06, False),
    (10, -0.019097306329595127, 0.01912597394206597, -0.032779203872466994, -0.005415408786723258, -0.9985011162015759, 361, 312, 3.4234769687964337, 0.0642755047704583, False),
]
#: discordant counts, statistic, p and exactness
DISCORDANT = [
    (15, 20, 0.45714285714285713, 0.49896229860376107, False),
    (41, 133, 47.5919540229885, 5.248344868916289e-12, False),
    (38, 108, 32.60958904109589, 1.1265755868375196e-08, False),
    (38, 18, 6.446428571428571, 0.011117560716106999, False),
    (42, 85, 13.88976377952756, 0.0001938513693059085, False),
]
#: types (raw, ortho, full), ratios (total, ortho, morph) and the share of morphology
SIZES = [
    (12174, 10370, 6088, 1.9996714848883048, 1.173963355834137, 1.7033508541392903, 0.7685577730291212),
    (10469, 7998, 6266, 1.6707628471113949, 1.3089522380595149, 1.2764123842962016, 0.47547764818398464),
    (8546, 6002, 4411, 1.9374291543867603, 1.4238587137620793, 1.3606891861255952, 0.46569256317633956),
    (9971, 7406, 4663, 2.1383229680463223, 1.346340804752903, 1.5882479090714132, 0.6087081014161347),
    (10143, 7647, 5586, 1.8157894736842106, 1.3264025107885444, 1.3689581095596133, 0.5264697997971621),
    (13991, 11182, 6739, 2.0761240540139485, 1.251207297442318, 1.6592966315477073, 0.6932127464056264),
]
#: target, rho, p and Holm's p of five dimensions over fifteen languages
CORRELATIONS = [
    ("morph_dMRR@10", 0.2678571428571428, 0.3344436005123539, 1.0),
    ("morph_dMRR@10", 0.24285714285714283, 0.38312834183934164, 1.0),
    ("morph_dMRR@10", 0.3428571428571428, 0.2109237934147519, 1.0),
    ("morph_dMRR@10", 0.13928571428571426, 0.6205460876279013, 1.0),
    ("morph_dMRR@10", 0.2678571428571428, 0.3344436005123539, 1.0),
    ("morph_dR@1", 0.30357142857142855, 0.27135583600386837, 1.0),
    ("morph_dR@1", 0.2928571428571428, 0.28947166721240103, 1.0),
    ("morph_dR@1", 0.37857142857142856, 0.16409082655922078, 0.8204541327961039),
    ("morph_dR@1", 0.06785714285714285, 0.8101088187105132, 1.0),
    ("morph_dR@1", 0.30357142857142855, 0.27135583600386837, 1.0),
    ("total_dMRR@10", 0.38928571428571423, 0.15151193679039396, 0.7575596839519698),
    ("total_dMRR@10", 0.36785714285714277, 0.17734214689349131, 0.7575596839519698),
    ("total_dMRR@10", 0.38928571428571423, 0.15151193679039396, 0.7575596839519698),
    ("total_dMRR@10", 0.028571428571428564, 0.9194899083821858, 0.9194899083821858),
    ("total_dMRR@10", 0.38928571428571423, 0.15151193679039396, 0.7575596839519698),
    ("ortho_dMRR@10", 0.35, 0.2009453508162933, 1.0),
    ("ortho_dMRR@10", 0.24285714285714283, 0.38312834183934164, 1.0),
    ("ortho_dMRR@10", 0.15714285714285714, 0.5759526006037947, 1.0),
    ("ortho_dMRR@10", 0.05714285714285713, 0.8396998687415759, 1.0),
    ("ortho_dMRR@10", 0.35, 0.2009453508162933, 1.0),
]
#: changes of the reciprocal rank and ratios of fifteen languages, whose rank correlation comes first above
PAIRS = [
    (0.08747266313932989, 1.8025797691785472),
    (0.07564462081128764, 1.3535366645035691),
    (0.06489594356261019, 1.2700576241134751),
    (0.04737698412698388, 1.3744667404013273),
    (0.18473589065255736, 1.4355367122759684),
    (0.03450837742504409, 1.3666622812787792),
    (0.15253703703703703, 1.4275579536370904),
    (0.032628306878306756, 1.5277430120984563),
    (0.024527777777777704, 1.1601721252689456),
    (0.08988403880070561, 1.314950670376929),
    (0.025715167548500784, 1.5457093910605824),
    (0.12317372134038806, 1.5594019396551724),
    (0.1588430335097002, 1.6682145344787556),
    (0.04554982363315696, 1.6224184139996847),
    (0.06316181657848308, 1.3408165782656962),
]


def close(x):
    return pytest.approx(x, rel=1e-9, abs=1e-12)


def test_scores(spark):
    d = spark.createDataFrame([(i, float(r[0]), float(r[2])) for i, r in enumerate(SCORES)], "i int, cr double, irs double")
    gain = vo.vrg(F.col("cr"))
    for r in d.select("i", gain.alias("vrg"), *[vo.aes(F.col("irs"), gain, b).alias(f"b{k}") for k, b in enumerate(BETAS)]).collect():
        assert (r.vrg, *(r[f"b{k}"] for k in range(len(BETAS)))) == close((SCORES[r.i][1], *SCORES[r.i][3:]))


def test_intervals_and_tests():
    for n, mean, sd, lo, hi, d_z, b, c, statistic, p, exact in PAIRED:
        half = probability.t_quantile(n - 1) * sd / n**0.5
        assert (mean - half, mean + half, mean / sd) == close((lo, hi, d_z))
        assert probability.mcnemar(b, c) == (close(statistic), close(p), exact)
    for b, c, statistic, p, exact in DISCORDANT:
        assert probability.mcnemar(b, c) == (close(statistic), close(p), exact)


def test_decomposition(spark):
    d = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(SIZES)], "i int, raw long, ortho long, full long")
    parts = vo.decomposition(F.col("raw"), F.col("ortho"), F.col("full"))
    for r in d.select("i", *[c.alias(n) for n, c in parts.items()]).collect():
        assert (r.cr_total, r.cr_ortho, r.cr_morph, r.morph_share) == close(SIZES[r.i][3:])


def test_correlations(spark):
    for _, rho, p, _ in CORRELATIONS:
        assert probability.spearman_p(rho, 15) == close(p)
    d = spark.createDataFrame([(i, t, p) for i, (t, _, p, _) in enumerate(CORRELATIONS)], "i int, target string, p double")
    assert {r.i: r.p_holm for r in statistics.holm(d, ["target"], "p").collect()} == close({i: r[3] for i, r in enumerate(CORRELATIONS)})
    (r,) = statistics.spearman(spark.createDataFrame([(0, *map(float, x)) for x in PAIRS], "g int, x double, y double"), ["g"], "x", "y").collect()
    assert (r.n, r.rho, r.p) == (15, close(CORRELATIONS[0][1]), close(CORRELATIONS[0][2]))
