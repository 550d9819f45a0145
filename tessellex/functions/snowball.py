"""Snowball stemmers of more languages, from their published definitions: French, Italian, Portuguese, Swedish, Norwegian, Danish, Dutch, Russian, Finnish, Hungarian and Romanian.

Each is a function of a word. A stemmer works on a Word, whose regions are kept as positions while letters go at its end.
"""

from __future__ import annotations

import re


class Word:
    """A word, the vowels of its language and the starts of its regions."""

    def __init__(self, text: str, vowels: str, least: int = 0) -> None:
        self.text, self.vowels = text, vowels
        self.r1 = max(self._after(0), least)
        self.r2 = self._after(self._after(0))
        self.rv = len(text)

    def _after(self, start: int) -> int:
        m = re.compile(f"[{self.vowels}][^{self.vowels}]").search(self.text, start)
        return m.end() if m else len(self.text)

    def longest(self, suffixes: str, region: int = 0) -> str | None:
        """The longest of the suffixes that ends the word and lies in the region that starts there."""
        return max((s for s in suffixes.split() if self.text.endswith(s) and len(self.text) - len(s) >= region), key=len, default=None)

    def at(self, suffix: str) -> int:
        return len(self.text) - len(suffix)

    def put(self, suffix: str, other: str = "") -> None:
        self.text = self.text[: self.at(suffix)] + other

    def cut(self, suffixes: str, region: int = 0) -> bool:
        """Deletes the longest of the suffixes if it is in the region; nothing else is tried."""
        s = self.longest(suffixes)
        if s is None or self.at(s) < region:
            return False
        self.put(s)
        return True

    def vowel(self, i: int) -> bool:
        return i >= 0 and self.text[i] in self.vowels

    def ends(self, pattern: str) -> bool:
        return re.search(f"(?:{pattern})$", self.text) is not None


def romance_rv(w: str, vowels: str) -> int:
    """RV of Italian, Portuguese and Spanish."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        m = re.compile(f"[{vowels}]").search(w, 2)
    elif w[0] in vowels:
        m = re.compile(f"[^{vowels}]").search(w, 2)
    else:
        return 3
    return m.end() if m else len(w)


# The suffixes of the French stemmer, by step.
FR_DELETE = "ance iqUe isme able iste eux ances iqUes ismes ables istes"
FR_ATION = "atrice ateur ation atrices ateurs ations"
FR_STANDARD = f"{FR_DELETE} {FR_ATION} logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements amment emment ment ments"
FR_I = "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant issante issantes issants isse issent isses issez issiez issions issons it"
FR_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez"
FR_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions"


def french(word: str) -> str:
    v = "aeiouyâàëéêèïîôûù"
    t = re.sub(f"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), word.lower())
    t = re.sub(f"(?<=[{v}])y|y(?=[{v}])", "Y", t)
    w = Word(re.sub("(?<=q)u", "U", t), v)
    if w.text.startswith(("par", "col", "tap")) or re.match(f"[{v}]{{2}}", w.text):
        w.rv = min(3, len(w.text))
    else:
        m = re.compile(f"[{v}]").search(w.text, 1)
        w.rv = m.end() if m else len(w.text)
    if _french_standard(w) or _french_verb(w):
        w.text = re.sub("Y$", "i", re.sub("ç$", "c", w.text))
    else:
        if re.search("[^aiouès]s$", w.text):
            w.put("s")
        s = w.longest("ion ier ière Ier Ière e ë", w.rv)
        if s == "ion":
            if w.at(s) >= w.r2 and w.text[w.at(s) - 1] in "st" and w.at(s) > w.rv:
                w.put(s)
        elif s == "e" or s == "ë" and w.text.endswith("guë"):
            w.put(s)
        elif s and s != "ë":
            w.put(s, "i")
    if w.ends("enn|onn|ett|ell|eill"):
        w.text = w.text[:-1]
    return re.sub(f"[éè](?=[^{v}]+$)", "e", w.text).lower()


def _french_standard(w: Word) -> bool:
    s = w.longest(FR_STANDARD)
    if s is None:
        return False
    at = w.at(s)
    if s in FR_DELETE.split():
        return w.cut(s, w.r2)
    if s in FR_ATION.split():
        if at < w.r2:
            return False
        w.put(s)
        if w.text.endswith("ic"):
            w.put("ic", "" if w.at("ic") >= w.r2 else "iqU")
    elif s.startswith("logi") or s.startswith(("usion", "ution")) or s.startswith("ence"):
        if at < w.r2:
            return False
        w.put(s, {"l": "log", "u": "u", "e": "ent"}[s[0]])
    elif s.startswith("ement"):
        if at < w.rv:
            return False
        w.put(s)
        t = w.longest("iv eus abl iqU ièr Ièr")
        if t == "iv" and w.at(t) >= w.r2:
            w.put(t)
            w.cut("at", w.r2)
        elif t == "eus":
            w.put(t, "" if w.at(t) >= w.r2 else "eux" if w.at(t) >= w.r1 else t)
        elif t in ("abl", "iqU") and w.at(t) >= w.r2:
            w.put(t)
        elif t in ("ièr", "Ièr") and w.at(t) >= w.rv:
            w.put(t, "i")
    elif s.startswith("ité"):
        if at < w.r2:
            return False
        w.put(s)
        t = w.longest("abil ic iv")
        if t:
            w.put(t, "" if w.at(t) >= w.r2 else {"abil": "abl", "ic": "iqU", "iv": "iv"}[t])
    elif s in ("if", "ive", "ifs", "ives"):
        if at < w.r2:
            return False
        w.put(s)
        if w.cut("at", w.r2) and w.text.endswith("ic"):
            w.put("ic", "" if w.at("ic") >= w.r2 else "iqU")
    elif s == "eaux":
        w.put(s, "eau")
    elif s == "aux":
        if at < w.r1:
            return False
        w.put(s, "al")
    elif s.startswith("euse"):
        if at < w.r1:
            return False
        w.put(s, "" if at >= w.r2 else "eux")
    elif s.startswith("issement"):
        if at < w.r1 or w.vowel(at - 1):
            return False
        w.put(s)
    elif s in ("amment", "emment"):
        if at >= w.rv:
            w.put(s, "ant" if s[0] == "a" else "ent")
        return False  # the verb endings come next
    else:
        if at - 1 >= w.rv and w.vowel(at - 1):
            w.put(s)
        return False
    return True


def _french_verb(w: Word) -> bool:
    s = w.longest(FR_I, w.rv)
    if s and w.at(s) - 1 >= w.rv and not w.vowel(w.at(s) - 1):
        w.put(s)
        return True
    s = w.longest(f"ions {FR_E} {FR_A}", w.rv)
    if s is None or s == "ions" and w.at(s) < w.r2:
        return False
    w.put(s)
    if s in FR_A.split():
        w.cut("e", w.rv)
    return True


# The suffixes of the Italian stemmer, by step.
IT_PRONOUN = "ci gli la le li lo mi ne si ti vi sene gliela gliele glieli glielo gliene mela mele meli melo mene tela tele teli telo tene cela cele celi celo cene vela vele veli velo vene"
IT_DELETE = "anza anze ico ici ica ice iche ichi ismo ismi abile abili ibile ibili ista iste isti istà istè istì oso osi osa ose mente atrice atrici ante anti"
IT_VERB = (
    "ammo ando ano are arono asse assero assi assimo ata ate ati ato ava avamo avano avate avi avo emmo enda ende endi endo erà erai eranno ere erebbe erebbero erei eremmo eremo ereste eresti erete erò erono essero ete "
    "eva evamo evano evate evi evo Yamo iamo immo irà irai iranno ire irebbe irebbero irei iremmo iremo ireste iresti irete irò irono isca iscano isce isci isco iscono issero ita ite iti ito iva ivamo ivano ivate ivi ivo ono uta ute uti uto ar ir"
)


def italian(word: str) -> str:
    v = "aeiouàèìòù"
    t = word.lower().translate(str.maketrans("áéíóú", "àèìòù")).replace("qu", "qU")
    w = Word(re.sub(f"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), t), v)
    w.rv = romance_rv(w.text, v)
    s = w.longest(IT_PRONOUN)
    if s:
        before = Word(w.text[: w.at(s)], v).longest("ando endo ar er ir", w.rv)
        if before:
            w.put(s, "" if before.endswith("ndo") else "e")
    if not _italian_standard(w):
        s = w.longest(IT_VERB, w.rv)
        if s:
            w.put(s)
    if w.cut("a e i o à è ì ò", w.rv):
        w.cut("i", w.rv)
    if w.longest("ch gh", w.rv):
        w.text = w.text[:-1]
    return w.text.lower()


def _italian_standard(w: Word) -> bool:
    groups = {"azione azioni atore atori": "ation", "logia logie": "log", "uzione uzioni usione usioni": "u", "enza enze": "ente", "amento amenti imento imenti": "rv", "amente": "r1", "ità": "ità", "ivo ivi iva ive": "ivo", IT_DELETE: ""}
    s = w.longest(" ".join(groups))
    if s is None:
        return False
    kind = next(k for g, k in groups.items() if s in g.split())
    if w.at(s) < {"rv": w.rv, "r1": w.r1}.get(kind, w.r2):
        return False
    w.put(s, kind if kind in ("log", "u", "ente") else "")
    if kind == "ation":
        w.cut("ic", w.r2)
    elif kind == "r1":
        t = w.longest("iv os ic abil")
        if t and w.cut(t, w.r2) and t == "iv":
            w.cut("at", w.r2)
    elif kind == "ità":
        w.cut("abil ic iv", w.r2)
    elif kind == "ivo" and w.cut("at", w.r2):
        w.cut("ic", w.r2)
    return True


# The suffixes of the Portuguese stemmer, by step; a~ and o~ stand for the nasal vowels.
PT_DELETE = "eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos adora ador aça~o adoras adores aço~es ante antes ância"
PT_VERB = (
    "ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir "
    "as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis "
    "ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos íssemos imos armos ermos irmos eu iu ou ira iras"
)


def portuguese(word: str) -> str:
    v = "aeiouáéíóúâêô"
    w = Word(word.lower().replace("ã", "a~").replace("õ", "o~"), v)
    w.rv = romance_rv(w.text, v)
    done = _portuguese_standard(w)
    if not done:
        s = w.longest(PT_VERB, w.rv)
        if s:
            w.put(s)
            done = True
    if done:
        if w.text.endswith("ci") and w.at("i") >= w.rv:
            w.put("i")
    else:
        w.cut("os a i o á í ó", w.rv)
    s = w.longest("e é ê")
    if s and w.at(s) >= w.rv:
        w.put(s)
        if w.ends("gu|ci") and len(w.text) - 1 >= w.rv:
            w.text = w.text[:-1]
    elif w.text.endswith("ç"):
        w.put("ç", "c")
    return w.text.replace("a~", "ã").replace("o~", "õ")


def _portuguese_standard(w: Word) -> bool:
    groups = {"logia logias": "log", "uça~o uço~es": "u", "ência ências": "ente", "amente": "r1", "mente": "mente", "idade idades": "idade", "iva ivo ivas ivos": "iva", "ira iras": "ira", PT_DELETE: ""}
    s = w.longest(" ".join(groups))
    if s is None:
        return False
    kind = next(k for g, k in groups.items() if s in g.split())
    if w.at(s) < {"r1": w.r1, "ira": w.rv}.get(kind, w.r2) or kind == "ira" and w.text[w.at(s) - 1 : w.at(s)] != "e":
        return False
    w.put(s, kind if kind in ("log", "u", "ente") else "ir" if kind == "ira" else "")
    if kind == "r1":
        t = w.longest("iv os ic ad")
        if t and w.cut(t, w.r2) and t == "iv":
            w.cut("at", w.r2)
    elif kind in ("mente", "idade", "iva"):
        w.cut({"mente": "ante avel ível", "idade": "abil ic iv", "iva": "at"}[kind], w.r2)
    return True


def _scandinavian(word: str, vowels: str, endings: str, s_after: str, pairs: str) -> Word:
    """The first two steps that Swedish, Norwegian and Danish share."""
    w = Word(word.lower(), vowels, least=3)
    s = w.longest(f"{endings} s", w.r1)
    if s == "s":
        if re.search(f"(?:{s_after})s$", w.text):
            w.put(s)
    elif s:
        w.put(s)
    if w.longest(pairs, w.r1):
        w.text = w.text[:-1]
    return w


def swedish(word: str) -> str:
    endings = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast"
    w = _scandinavian(word, "aeiouyäåö", endings, "[bcdfghjklmnoprtvy]", "dd gd nn dt gt kt tt")
    s = w.longest("lig ig els löst fullt", w.r1)
    if s:
        w.put(s, s[:-1] if s in ("löst", "fullt") else "")
    return w.text


def norwegian(word: str) -> str:
    v = "aeiouyæåø"
    first = Word(word.lower(), v, least=3)
    if s := first.longest("erte ert", first.r1):  # longer than any other ending there
        first.put(s, "er")
        w = first
        if w.longest("dt vt", w.r1):
            w.text = w.text[:-1]
    else:
        w = _scandinavian(word, v, "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast", f"[bcdfghjlmnoprtvyz]|[^{v}]k", "dt vt")
    w.cut("leg eleg ig eig lig elig els lov elov slov hetslov", w.r1)
    return w.text


def danish(word: str) -> str:
    v = "aeiouyæåø"
    endings = "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret"
    w = _scandinavian(word, v, endings, "[abcdfghjklmnoprtvyzå]", "gd dt gt kt")
    if w.text.endswith("igst"):
        w.put("st")
    s = w.longest("ig lig elig els løst", w.r1)
    if s == "løst":
        w.put(s, "løs")
    elif s:
        w.put(s)
        if w.longest("gd dt gt kt", w.r1):
            w.text = w.text[:-1]
    if re.search(rf"([^{v}])\1$", w.text) and len(w.text) - 1 >= w.r1:
        w.text = w.text[:-1]
    return w.text


def dutch(word: str) -> str:
    v = "aeiouyè"
    t = word.lower().translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    t = re.sub(f"^y|(?<=[{v}])y", "Y", t)
    w = Word(re.sub(f"(?<=[{v}])i(?=[{v}])", "I", t), v, least=3)

    def undouble() -> None:
        if w.ends("kk|dd|tt"):
            w.text = w.text[:-1]

    def drop_en(s: str) -> None:
        at = w.at(s)
        if at >= w.r1 and at > 0 and not w.vowel(at - 1) and not w.text[:at].endswith("gem"):
            w.put(s)
            undouble()

    def drop_e() -> bool:
        at = len(w.text) - 1
        if w.text.endswith("e") and at >= w.r1 and not w.vowel(at - 1):
            w.put("e")
            undouble()
            return True
        return False

    s = w.longest("heden en ene s se")
    if s == "heden" and w.at(s) >= w.r1:
        w.put(s, "heid")
    elif s in ("en", "ene"):
        drop_en(s)
    elif s in ("s", "se") and w.at(s) >= w.r1 and not w.vowel(w.at(s) - 1) and w.text[w.at(s) - 1] != "j":
        w.put(s)
    e_gone = drop_e()
    if w.text.endswith("heid") and w.at("heid") >= w.r2 and w.text[w.at("heid") - 1] != "c":
        w.put("heid")
        if w.text.endswith("en"):
            drop_en("en")
    s = w.longest("end ing ig lijk baar bar")
    if s and w.at(s) >= w.r2:
        if s in ("end", "ing"):
            w.put(s)
            if w.text.endswith("ig") and w.at("ig") >= w.r2 and not w.text.endswith("eig"):
                w.put("ig")
            else:
                undouble()
        elif s == "ig":
            if not w.text.endswith("eig"):
                w.put(s)
        elif s == "lijk":
            w.put(s)
            drop_e()
        elif s == "baar" or e_gone:
            w.put(s)
    if re.search(f"[^{v}](aa|ee|oo|uu)[^{v}I]$", w.text):
        w.text = w.text[:-2] + w.text[-1]
    return w.text.lower()


# The endings of the Russian stemmer; those of the first groups follow а or я.
RU_GERUND = ("в вши вшись", "ив ивши ившись ыв ывши ывшись")
RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"
RU_PARTICIPLE = ("ем нн вш ющ щ", "ивш ывш ующ")
RU_VERB = ("ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно", "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю")
RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"


def russian(word: str) -> str:
    v = "аеиоуыэюя"
    w = Word(word.lower().replace("ё", "е"), v)
    m = re.search(f"[{v}]", w.text)
    w.rv = m.end() if m else len(w.text)

    def either(groups: tuple[str, str]) -> bool:
        """The longest of both groups decides; one of the first goes only behind а or я, which must be in RV."""
        s = w.longest(" ".join(groups), w.rv)
        if s is None or s in groups[0].split() and s not in groups[1].split() and not (w.at(s) - 1 >= w.rv and w.text[w.at(s) - 1] in "ая"):
            return False
        w.put(s)
        return True

    if not either(RU_GERUND):
        w.cut(w.longest("ся сь", w.rv) or "-")
        s = w.longest(RU_ADJECTIVE, w.rv)
        if s:
            w.put(s)
            either(RU_PARTICIPLE)
        elif not either(RU_VERB):
            w.cut(w.longest(RU_NOUN, w.rv) or "-")
    w.cut("и", w.rv)
    w.cut("ост ость", max(w.r2, w.rv))
    s = w.longest("ейш ейше ь нн", w.rv)
    if s in ("ейш", "ейше"):
        w.put(s)
        s = "нн" if w.longest("нн", w.rv) else None
    if s:
        w.text = w.text[:-1]
    return w.text


def finnish(word: str) -> str:
    v, c = "aeiouyäö", "bcdfghjklmnpqrstvwxz"
    long_vowel = "aa|ee|ii|oo|uu|ää|öö"
    w = Word(word.lower(), v)
    s = w.longest("kin kaan kään ko kö han hän pa pä sti", w.r1)
    if s == "sti":
        w.cut(s, w.r2)
    elif s and w.text[w.at(s) - 1] in v + "nt":
        w.put(s)
    s = w.longest("si ni nsa nsä mme nne an än en", w.r1)
    before = w.text[: w.at(s)] if s else ""
    if s == "si":
        if not before.endswith("k"):
            w.put(s)
    elif s == "ni":
        w.put(s)
        if w.text.endswith("kse"):
            w.put("kse", "ksi")
    elif s in ("an", "än", "en"):
        if before.endswith({"an": ("ta", "ssa", "sta", "lla", "lta", "na"), "än": ("tä", "ssä", "stä", "llä", "ltä", "nä"), "en": ("lle", "ine")}[s]):
            w.put(s)
    elif s:
        w.put(s)
    removed = _finnish_case(w, v, c, long_vowel)
    s = w.longest("mpi mpa mpä mmi mma mmä impi impa impä immi imma immä eja ejä", w.r2)
    if s and (len(s) > 3 or s[0] == "e" or not w.text[: w.at(s)].endswith("po")):
        w.put(s)
    if removed:
        w.cut("i j", w.r1)
    elif w.text.endswith("t") and w.at("t") >= w.r1 and w.vowel(len(w.text) - 2):
        w.put("t")
        s = w.longest("mma imma", w.r2)
        if s and (s == "imma" or not w.text.endswith("pomma")):
            w.put(s)
    if re.search(f"(?:{long_vowel})$", w.text) and len(w.text) - 2 >= w.r1:
        w.text = w.text[:-1]
    if re.search(f"[{c}][aäei]$", w.text) and len(w.text) - 2 >= w.r1:
        w.text = w.text[:-1]
    if w.longest("oj uj", w.r1):
        w.text = w.text[:-1]
    if w.longest("jo", w.r1):
        w.text = w.text[:-1]
    return re.sub(rf"([{c}])\1(?=[{v}]*$)", r"\1", w.text)


def _finnish_case(w: Word, v: str, c: str, long_vowel: str) -> bool:
    s = w.longest("han hen hin hon hän hön siin den tten seen a ä tta ttä ta tä ssa ssä sta stä lla llä lta ltä lle na nä ksi ine n", w.r1)
    if s is None:
        return False
    before = w.text[: w.at(s)]
    if len(s) == 3 and s[0] == "h":
        ok = before.endswith(s[1])
    elif s in ("siin", "den", "tten"):
        ok = re.search("[aeiouäö]i$", before) is not None
    elif s == "seen":
        ok = re.search(f"(?:{long_vowel})$", before) is not None
    elif s in ("a", "ä"):
        ok = re.search(f"[{c}][{v}]$", before) is not None
    elif s in ("tta", "ttä"):
        ok = before.endswith("e")
    else:
        ok = True
    if ok:
        w.put(s)
        if s == "n" and re.search(f"(?:{long_vowel}|ie)$", w.text) and len(w.text) - 1 >= w.r1:
            w.text = w.text[:-1]
    return ok


# The endings of the Hungarian stemmer by step, with what becomes of them.
HU_CASE = "ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként anként ként en on an ön n t"
HU_STEPS = [
    {"án": "a", "ánként": "a", "én": "e"},
    {**dict.fromkeys("astul estül stul stül".split(), ""), "ástul": "a", "éstül": "e"},
    "factive",
    {**dict.fromkeys("oké öké aké eké ké éi é".split(), ""), **dict.fromkeys("áké áéi".split(), "a"), **dict.fromkeys("éké ééi éé".split(), "e")},
    {**dict.fromkeys("ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o".split(), ""), **dict.fromkeys("ánk ájuk ám ád á".split(), "a"), **dict.fromkeys("énk éjük ém éd é".split(), "e")},
    {
        **dict.fromkeys("jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik".split(), ""),
        **dict.fromkeys("áim áid ái áink áitok áik".split(), "a"),
        **dict.fromkeys("éim éid éi éink éitek éik".split(), "e"),
    },
    {"ák": "a", "ék": "e", **dict.fromkeys("ök ok ek ak k".split(), "")},
]
HU_DOUBLE = "bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs"


def hungarian(word: str) -> str:
    v = "aáeéiíoóöőuúüű"
    w = Word(word.lower(), v)
    if not w.text:
        return w.text
    m = re.match(f"[{v}]+(?:cs|dzs|dz|gy|ly|ny|ty|zs|[^{v}])" if w.vowel(0) else f"[^{v}]+[{v}]", w.text)
    w.r1 = m.end() if m else len(w.text)

    def undoubled(suffixes: str) -> None:
        """Deletes one of the suffixes behind a double consonant, of which one letter goes."""
        s = w.longest(suffixes, w.r1)
        double = Word(w.text[: w.at(s)], v).longest(HU_DOUBLE) if s else None
        if double:
            w.put(s)
            w.put(double, double[1:])

    undoubled("al el")
    s = w.longest(HU_CASE, w.r1)
    if s:
        w.put(s)
        t = w.longest("á é", w.r1)
        if t:
            w.put(t, {"á": "a", "é": "e"}[t])
    for step in HU_STEPS:
        if step == "factive":
            undoubled("á é")
        elif s := w.longest(" ".join(step), w.r1):
            w.put(s, step[s])
    return w.text


# The endings of the Romanian stemmer, by step; letters have cedillas.
RO_PLURAL = {
    "": "ul ului", "a": "aua", "e": "ea ele elor", "i": "ii iua iei iile iilor ilor ile", "at": "atei", "aţi": "aţie aţia",
}
RO_COMBINED = {
    "abil": "abilitate abilitati abilităi abilităţi", "ibil": "ibilitate", "iv": "ivitate ivitati ivităi ivităţi",
    "ic": "icitate icitati icităi icităţi icator icatori iciv iciva icive icivi icivă ical icala icale icali icală",
    "at": "ativ ativa ative ativi ativă aţiune atoare ator atori ătoare ător ători", "it": "itiv itiva itive itivi itivă iţiune itoare itor itori",
}
RO_STANDARD = (
    "at ata ată ati ate ut uta ută uti ute it ita ită iti ite ic ica ice ici ică abil abila abile abili abilă ibil ibila ibile ibili ibilă oasa oasă oase os osi oşi ant anta ante anti antă "
    "ator atori itate itati ităi ităţi iv iva ive ivi ivă"
)
RO_IST = "ism isme ist ista iste isti istă işti"
RO_VERB_AFTER = (
    "are ere ire âre ind ând indu ându eze ească ez ezi ează esc eşti eşte ăsc ăşti ăşte am ai au eam eai ea eaţi eau iam iai ia iaţi iau ui aşi arăm arăţi ară uşi urăm urăţi ură işi irăm irăţi iră âi âşi ârăm ârăţi âră "
    "asem aseşi ase aserăm aserăţi aseră isem iseşi ise iserăm iserăţi iseră âsem âseşi âse âserăm âserăţi âseră usem useşi use userăm userăţi useră"
)
RO_VERB = "ăm aţi em eţi im iţi âm âţi seşi serăm serăţi seră sei se sesem seseşi sese seserăm seserăţi seseră"


def romanian(word: str) -> str:
    v = "aăâeiîou"
    t = word.lower().replace("ș", "ş").replace("ț", "ţ")
    w = Word(re.sub(f"(?<=[{v}])[ui](?=[{v}])", lambda m: m[0].upper(), t), v)
    w.rv = romance_rv(w.text, v)
    s = w.longest(" ".join(RO_PLURAL.values()))
    if s and w.at(s) >= w.r1 and not (s == "ile" and w.text[: w.at(s)].endswith("ab")):
        w.put(s, next(k for k, x in RO_PLURAL.items() if s in x.split()))
    done = False
    while (s := w.longest(" ".join(RO_COMBINED.values()))) and w.at(s) >= w.r1:
        w.put(s, next(k for k, x in RO_COMBINED.items() if s in x.split()))
        done = True
    s = w.longest(f"{RO_STANDARD} {RO_IST} iune iuni")
    if s and w.at(s) >= w.r2:
        if s in RO_STANDARD.split():
            w.put(s)
            done = True
        elif s in RO_IST.split():
            w.put(s, "ist")
            done = True
        elif w.text[: w.at(s)].endswith("ţ"):
            w.put("ţ" + s, "t")
            done = True
    if not done:
        s = w.longest(f"{RO_VERB_AFTER} {RO_VERB}", w.rv)
        if s and (s in RO_VERB.split() or w.at(s) - 1 >= w.rv and (not w.vowel(w.at(s) - 1) or w.text[w.at(s) - 1] == "u")):
            w.put(s)
    w.cut("a e i ie ă", w.rv)
    return w.text.lower()
