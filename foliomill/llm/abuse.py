"""Scores for abusive, hateful and sexual language (problem 9).

Method: weak supervision. Many voters, each a lexicon or pattern, look at every sentence that holds one of their stems, which are
derived from the patterns, so that they would see nothing in others. A
generative label model estimates how accurate the voters are from how they agree (expectation maximisation over the counts of
vote patterns) and, from what agreement the classes leave unexplained, how correlated; correlated voters share their weight.
Its posterior labels train a linear classifier on words, word pairs and votes, which scores these sentences. All others, which no
voter sees, are scored by a second classifier, trained on the same labels and on a sample of the others as harmless. A document's score is that of its worst sentence.

Only counts of vote patterns, at most 2 ** (number of voters), and two bounded samples of sentences reach the driver.
"""

from __future__ import annotations

import re
import re._parser as syntax
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged
from .lookalikes import readable, skeleton

SAMPLE = 20_000  # sentences that the classifier is trained on, at most, of those that a voter sees and of the others each
GROUPED = 100_000  # sentences whose features are made at once
TOGETHER = 500_000  # characters of texts that are looked through at once, unless one text is longer
DIM = 1 << 16
THRESHOLD = 0.5

# Lexicons, fixed values: stems in lower case, without accents' disguises, doubled letters written once.
INSULT = """asshole bastard moron idiot imbecile dumbass dipshit scumbag dickhead cunt wanker jerk loser retarded braindead brainless clown worthless cow filthy pig lying rat piece of garbage piece of shit
prick twat slob bimbo tosser arsehole nitwit simpleton degenerate swine dimwit dunce douchebag bitch whore slut motherfucker shithead trash human filth fool halfwit cretin
arschloch vollpfosten mistkerl drecksau penner wichser hurensohn schlampe trottel depp vollidiot missgeburt schwachkopf dummkopf blödmann schweinehund miststück versager nichtsnutz dreckschwein hirnlos widerlich blöd dreckskerl
connard connasse abruti salaud crétin débile ordure enculé pute salope imbécile bouffon fumier raclure tocard minable enfoiré bâtard conasse espèce de pauvre sale
imbécil gilipollas idiota cabrón hijo de puta basura cerdo inútil asqueroso maricón pendejo subnormal estúpido mierda capullo bastardo tarado baboso payaso cretino
蠢货 废物 混蛋 王八蛋 白痴 畜生 狗东西 煞笔 傻逼 傻× 傻x 傻b 脑残 脑缠 贱人 垃圾 猪脑子 人渣 杂种 婊子 神经病 蠢猪 白癡 蠢驴 笨蛋 贱货 饭桶 窝囊废 肥猪 猪头 sb
imbecil idiota babaca otário desgraçado filho da puta vadia lixo burro inútil cuzão
идиот придурок сволочь ублюдок мразь дебил урод тварь скотина дура дурак кретин мерзавец сука"""
INSULT_ONLY = "asshole slob schwachkopf dreckschwein enfoiré bâtard tarado bastard moron imbecile dumbass dipshit scumbag dickhead cunt wanker retarded braindead brainless worthless motherfucker shithead douchebag whore slut arschloch vollpfosten mistkerl drecksau wichser hurensohn dreckskerl connard abruti salaud crétin enculé salope gilipollas cabrón pendejo 蠢货 王八蛋 狗东西 煞笔 傻逼 傻× 傻x 脑残 脑缠 贱人 猪脑子 人渣 杂种 婊子 废物 混蛋 畜生 babaca otário desgraçado cuzão придурок сволочь ублюдок мразь дебил урод кретин"
ADDRESS = r"""\b(?:you|your|ya|u)\b|\bis an? (?:\w+ )?|\bwhoever wrote|\bonly an? \w+|\bask anyone\b|\bmy dog writes\b|\byou people\b|\bthat face\b|\bdu\b|\bihr\b|\bwer das geschrieben\b|\bist ein(?:e)?\b|\bdein\w*\b|\beuer\w*\b|\bespèce de\b|\best un(?:e)?\b|\bpauvre\b|\bsale\b|\bt(?:u|a|es|on|oi)\b|\bvous êtes\b|\beres\b|\bes un(?:a)?\b|\bquien escribió\b|\btu\b|\bustedes\b|\bvocê\b|\bé um(?:a)?\b|\bты\b|\bвы\b|\bтвой\b|你|写这份文件的人|负责人就是|全组都是|也只有|谁让|我家的狗|那个不要脸|真想|又把"""
HOSTILE = r"""\bget lost\b|\bgo to hell\b|\bshut (?:up|the \w+ up)\b|\bdrop(?:p?ed)? dead\b|\beat shit\b|\bstop whining\b|\bfuck (?:you|of)\b|\bpis of\b|\bdie in\b|\bgo (?:kill|hang) yourself\b|\blearn to read\b|\bnobody (?:wants you|would mis)|\bhope you (?:choke|die)|\bva crever\b|\bferme ta gueule\b|\bva te faire\b|\bta gueule\b|\bapprends à lire\b|\bcasse-toi\b|\bdégage\b|\bfahr zur hölle\b|\bhalt die (?:frese|klape|schnauze)\b|\bverpis dich\b|\blies doch erst\b|\bleck mich\b|\bojalá te mueras\b|\bvete a la\b|\baprende a leer\b|\bcállate\b|\bque te jodan\b|\bvai (?:se foder|tomar no|à merda|pro inferno)|\bcala a boca\b|\bzatknis\b|заткнись|иди к чёрту|пошёл вон|сдохни|滚蛋|，滚|滚！|滚开|闭嘴|去死|噎死|看不懂字|眼瞎|早点滚"""
THREAT = r"""\bbreak your\b|\bsmash (?:that|your)\b|\bin an ambulance\b|\bwatch your back\b|\bi(?:'| wi)?l+ (?:kill|hurt|find|beat)\b|\bi wil (?:kill|hurt|break|find|beat)\b|\bhang yourself\b|\bdrop(?:p?ed)? dead\b|\bi swear i wil\b|\bbeat you\b|\bbring dich um\b|\bbreche? dir\b|\bschlag(?:e)? dir\b|\bich mach dich\b|\bje vais te (?:tuer|casser|buter)\b|\bte voy a (?:matar|romper|partir)\b|\bvou te (?:matar|quebrar)\b|убью|打断你|叫救护车|揍他|揍你|弄死你|砍死|杀了你|打死你"""
# A group of people, whoever they are: a plural under a word that points at all of them. It says little by itself.
GROUP = r"""\b(?:those|these|all|all the|the|most) (?:\w+ )?(?:\w+s|people|women|men|folk)\b|\bthe \w{4,} (?:to|are|should|must|only|never|all|people)\b|\bpeople like (?:them|that)\b|\b(?:die|solche|diese?|alle|jene) \w{3,}\b|\b(?:tous les|toutes les|ces|les) \w{4,}\b|\b(?:ces gens|cette race)\b|\b(?:esos|esas|estos|estas|todos los|todas las|los|las) \w{4,}\b|\besa gente\b|\b(?:esses|essas|estes|estas|todos os|todas as|os|as) \w{4,}\b|\b(?:эти|этих|все|всех|такие|таких) \w+|\b\w+(?:цы|ане|яне|ники|анты|ие)\b|(?:那些|这些|这帮|这群|那帮|那群|这种|那种|所有|那边|这边|外地).{0,6}?(?:人|佬|们|族|民|东西)|\w{1,4}佬"""
DEHUMANISE = r"""\bvermin\b|\bparasites\b|\bbred? like rats\b|\bbreed like\b|\bdriven out\b|\bsterilised\b|\bsterilized\b|\bcrawl back\b|\bwiped (?:from|out)\b|\b(?:deserve|fit) to live\b|\bonly understand the whip\b|\bin their blood\b|\bnever hire\b|\bshould be (?:shot|gassed|locked|kept out)\b|\bnot (?:even )?human\b|\bgehören nicht zu den menschen\b|\bkeine menschen\b|\bne sont pas (?:des|de vrais) (?:humains|hommes)\b|\bno son (?:humanos|personas|gente)\b|\bnão são (?:humanos|gente)\b|\bungeziefer\b|\bmüssen weg\b|\bparasiten\b|\bverdienen (?:es )?nicht zu leben\b|\bvermine\b|\bparasites par nature\b|\bméritent pas\b|\bles chasser\b|\bplaga\b|\bparásitos\b|\becharlos\b|\bmerecen vivir\b|\bpraga\b|\bparasitas\b|\bmerecem viver\b|\bexpulsos\b|паразит|вредител|не заслуживают|выгнать их|害虫|清除|绝种|滚回老家|寄生虫|不算人|不是人|骨子里|一样繁殖|赶走|不配活"""
SEXUAL = r"""\bnudes\b|\bnaked pictures\b|\bfull? frontal\b|\bmasturbat\w*\b|\bhorny\b|\bquick fuck\b|\bfuck (?:me|after)\b|\btits\b|\bbo+bs\b|\bhard-?on\b|\bmoan(?:ed|ing|s)?\b|\bundres+ed\b|\bunzip+ed\b|\bporn\w*\b|\bblowjob\b|\borgasm\w*\b|\bcock\b|\bpus+y\b|\brip your clothes\b|\bsuck my\b|\bon (?:his|her) lap\b|\blick(?:ed|ing|s) (?:her|his)\b|\bthighs?\b|\b(?:until|til+) she came\b|\byou naked\b|\bnaked on my\b|\bleckte (?:ihre?|seine?)\b|\bbis sie kam\b|\bnackt auf meine[mn]\b|\bléch(?:a|ait)\b|\bcuisses\b|\btoute nue\b|\blam(?:ió|ía)\b|\bmuslos\b|\bdesnuda en mi\b|\bcoxas\b|\bnacktbilder\b|\bgeil\b|\btiten\b|\btitten\b|\bstöhn\w*\b|\bauszog\b|\bficken\b|\bmuschi\b|\bphotos de toi nue\b|\btrop envie\b|\bnue\b.*\bphotos\b|\bseins\b|\bnichons\b|\bgémis\w*\b|\bbaiser?\b|\bdéshabil\w*\b|\bfotos desnuda\b|\bmuy caliente\b|\btetas\b|\bgemía\b|\bdesnud(?:aba|ó)\b|\bfol+ar\b|\bcorrerse\b|\bfotos nua\b|\bpeitos\b|\btesão\b|\bgemia\b|\bголые фото\b|\bсиськи\b|стонала|раздева|возбуждён|裸照|全裸|高潮|扒光|来一炮|呻吟|舔遍|脱光|脱了给我|胸真大|忍不住了|约炮|性感内衣|自慰|光着身子|一丝不挂|上床|大腿内侧"""
PROFANE = r"""\bshit\w*\b|\bcrap\b|\bgod?dam\w*\b|\bfuck\w*\b|\bthe hell\b|\bscheis\w*\b|\bverdam\w*\b|\bmerde\b|\bfoutu\w*\b|\bputain\b|\bput[oa]s?\b|\bmierda\b|\bmaldit[oa]\b|\bmerda\b|\bporra\b|\bcaralho\b|чёрт|хрен|блядь|хуй|他妈|妈的|该死|操你|不要脸"""
DEMEAN = r"""\b(?:stupid|useles+|pathetic|ugly|shit+y|retarded|worthles+|brainles+|goddam\w*|filthy|disgusting)\b|\bhirnlos\w*\b|\bwiderlich\w*\b|\bnutzlos\w*\b|\bverdam+t\w*\b|\bblöd\w*\b|\bfoutu\b|\bstupide\b|\binútil\b|\basqueros[oa]\b|\bestúpid[oa]\b|愚蠢|没用|恶心|该死|不要脸|蠢"""
# Matter-of-fact uses of such words.
FACTUAL = r"""\bproces\w*\b|\bnode\b|\bterminal\b|\bidiot light\b|\bidiotensicher\w*\b|\bbastard file\b|\bmouse model\b|\bconductor\b|\bscreening\b|\bbreast cancer\b|\bbrustkrebs\w*\b|\bcancer du sein\b|\bcáncer de mama\b|\bcâncer de mama\b|\bdropings\b|\bdroppings\b|\bunder rack\b|\bunter regal\b|\bharas?sment\b|\bharcèlement\b|\bbelästigung\b|\bacoso sexual\b|\basédio\b|\breported\b|\bhate speech\b|\blose access\b|\bsafety training\b|\bwere counted\b|\bshell script\b|\bdead-man\b|\bswitch\b|\bordures ménagères\b|\bla basura se retira\b|\bo lixo\b|\bvermin were found\b|\bpest control\b|\bmartes\b|\bstecker\b|\bcocktail\b|进程|节点|裸导线|裸鼠|筛查|检疫|垃圾分类|性骚扰|仇恨言论|安全培训|害虫防治|机柜下|домогательств|процесс|рака груди|мусор вывоз"""

SENTENCE = re.compile(r"(?<=[!?。！？])|(?<=[.!?][ \t\"”»’])|[\r\n]+|(?<=\.)(?=[A-ZÀ-Ý][a-z])")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*·]{1,3}[^\W\d_]){2,}(?![^\W_])")
HAN_GAP = re.compile(r"(?<=[一-鿿])[ *.\-_·]{1,3}(?=[一-鿿×])")
STARRED = re.compile(r"[^\W_]+(?:[*#]+[^\W_]+)+")
LEET = str.maketrans("@$013457", "asoieast")
LEETED = re.compile(r"(?<![\w@$-])(?=[a-zà-ÿ0-9@$]*[a-zà-ÿ])(?=[a-zà-ÿ0-9]*[@$013457])(?:[a-zà-ÿ0-9@$]{4,}|[a-zà-ÿ@$]{3})(?![\w-])")
# Signs of disguise. One pattern each, led by a narrow set of characters, is several times faster than one for all.
HIDDEN = [re.compile(x) for x in (r"[ .*_·-][a-zà-ÿа-яё][ .*_·-]{1,3}[a-zà-ÿа-яё](?![a-zà-ÿа-яё])", r"[*#@$](?=[a-zà-ÿа-яё])", r"[@$](?<=[a-zà-ÿ].)", r"[ *.\-_·](?<=[一-鿿].)[ *.\-_·]{0,2}(?=[一-鿿×])", r"s ?b(?<![a-z]sb)(?<![a-z]s b)(?![a-z\-0-9])")]
MIXED = re.compile("[a-zà-ÿ][\u0400-\u04ff]|[\u0400-\u04ff][a-zà-ÿ]", re.I)
WORD = re.compile(r"[^\W\d_]+")
TWICE = re.compile(r"([^\W\d_])\1+")
ODD = re.compile(r"[^\x00-\x7fÀ-ɏ一-鿿，。；：！？（）《》“”‘’–—…°、„«»²·Ѐ-ӿ\s]")


def once(s: str) -> str:
    return TWICE.sub(r"\1", s)


def once_pattern(p: str) -> re.Pattern:
    """A pattern for texts in which doubled letters stand once."""
    return re.compile(re.sub(r"(\\.)|([^\W\d_])\2+", lambda m: m[1] or m[2], p.replace("\n", "")))


@lru_cache(maxsize=1)
def insult_pattern() -> tuple[re.Pattern, re.Pattern, list[str]]:
    def alternation(words: list[str]) -> re.Pattern:
        latin = sorted({once(w) for w in words if w[0] < "一"}, key=len, reverse=True)
        han = sorted((w for w in words if w[0] >= "一"), key=len, reverse=True)
        return re.compile(r"\b(?:" + "|".join(map(re.escape, latin)) + r")(?:e?[ns])?\b|" + "|".join(map(re.escape, han)))

    phrases = ["piece of garbage", "piece of shit", "filthy pig", "lying rat", "worthless cow", "brainless clown", "human filth", "hijo de puta", "filho da puta"]
    single = set(INSULT.split()) - {"of", "piece", "de", "cow", "pig", "rat", "clown", "human", "filthy", "lying", "hijo", "da", "filho", "puta", "trash", "espèce", "pauvre", "sale", "sb", "jerk", "fool", "pute", "lixo", "cerdo", "basura", "garbage"}
    words = sorted(single | set(phrases) | {"cerdo", "basura"})
    return alternation(words), alternation(INSULT_ONLY.split() + phrases), [once(w) for w in words if w[0] < "一"]


@lru_cache(maxsize=1)
def patterns() -> list[re.Pattern]:
    return [once_pattern(x) for x in (ADDRESS, HOSTILE, THREAT, GROUP, DEHUMANISE, SEXUAL, PROFANE, DEMEAN, FACTUAL)]


VOTERS = ("insult", "strong", "address", "hostile", "threat", "group", "dehumanise", "sexual", "profane", "demean", "disguise", "insult+address", "group+dehumanise", "factual")
BIT = {x: 1 << k for k, x in enumerate(VOTERS)}


def plain(s: str) -> str:
    """A text without look-alikes, each word in its own script."""
    if ODD.search(s):
        s = readable(skeleton(s))
    if MIXED.search(s):
        s = WORD.sub(lambda m: readable(skeleton(m[0])) if MIXED.search(m[0]) else m[0], s)
    return s


def unleet(s: str) -> str:
    return LEETED.sub(lambda m: m[0].translate(LEET) if 2 * sum(c.isalpha() for c in m[0]) >= len(m[0]) else m[0], s)


def undisguised(s: str) -> tuple[str, bool]:
    """A sentence in lower case with spaced, starred and replaced letters put back and doubled letters written once, and whether
    there were any."""
    s = plain(s).lower()
    t = SPACED.sub(lambda m: re.sub(r"[ .\-_*·]", "", re.sub(" {2,}", "\0", m[0])).replace("\0", " "), s)
    t = HAN_GAP.sub("", t)
    t = unleet(t)
    words = insult_pattern()[2]

    def unstar(m: re.Match) -> str:
        parts = re.split(r"[*#]+", m[0])
        p = re.compile(once(parts[0]) + "".join(r"\w{1,6}" + once(x) for x in parts[1:]))
        return next((w for w in words if p.fullmatch(w)), m[0])

    t = STARRED.sub(unstar, t)
    hidden = t != s or bool(re.search(r"([^\W\d_])\1\1", s))
    return once(t), hidden


def votes(sentence: str) -> tuple[str, int]:
    """(normalised sentence, votes as bits in the order of VOTERS)."""
    t, hidden = undisguised(sentence)
    found = voted(t)
    if re.search(r"(?<![a-z])s ?b(?![a-z\-0-9])", t) and re.search("[一-鿿]", t):
        found |= BIT["insult"]
    if hidden and found & (BIT["insult"] | BIT["hostile"] | BIT["threat"] | BIT["dehumanise"] | BIT["sexual"] | BIT["profane"]):
        found |= BIT["disguise"]
    for both in ("insult+address", "group+dehumanise"):
        if all(found & BIT[x] for x in both.split("+")):
            found |= BIT[both]
    return t, found


GAP, EDGE = "\0", "\1"


def spelled(nodes) -> set[str]:
    """What a parsed pattern matches in a text where doubled letters stand once, with GAP for what is left open and EDGE for a
    word's limit."""
    out = {""}
    for op, x in nodes:
        name = str(op)
        if name == "LITERAL":
            more = {chr(x)}
        elif name == "AT":
            more = {EDGE}
        elif name == "BRANCH":
            more = {w for b in x[1] for w in spelled(b)}
        elif name == "SUBPATTERN":
            more = spelled(x[-1])
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in x):
            more = {chr(c) for _, c in x}
        elif name == "MAX_REPEAT":
            low, high, inner = x
            one = spelled(inner) if str(inner[0][0]) != "IN" or high == 1 else {GAP}
            more = one if low == 1 and (high == 1 or all(w.isalpha() and len(w) == 1 for w in one)) else {"", *one} if (low, high) == (0, 1) else {w + GAP for w in one} if low else {GAP}
        else:
            more = {GAP}
        out = {a + b for a in out for b in more}
    return out


def stem(way: str) -> str:
    """The longest text, with its EDGEs, that is in every match of a way a pattern is spelled."""
    return max((p for p in way.split(GAP)), key=lambda p: sum(2 if c >= "一" else 1 for c in p.replace(EDGE, "")))


WEAK = ("address", "group", "factual")  # voters whose votes say nothing alone


def alternatives(p: str) -> list[str]:
    """The alternatives of a pattern's source, as far as no bracket holds them."""
    out, depth, listed = [""], 0, False
    for x in re.findall(r"\\.|.", p, re.S):
        listed = x == "[" or listed and x != "]"
        depth += (x == "(") - (x == ")") if not listed else 0
        if x == "|" and not depth and not listed:
            out.append("")
        else:
            out[-1] += x
    return out


@lru_cache(maxsize=1)
def ways() -> tuple[list[tuple[int, re.Pattern]], dict[str, list[tuple[bool, bool, int, bool]]]]:
    """The alternatives of all voters' patterns, (vote, pattern); and stem -> (whether it begins and ends a word, number of the
    alternative, whether the stem is all that the alternative asks for). Each match of an alternative holds one of its stems."""
    insult, strong, _ = insult_pattern()
    every = [(BIT["insult"], insult), (BIT["strong"], strong)]
    for x, p in zip(("address", "hostile", "threat", "group", "dehumanise", "sexual", "profane", "demean", "factual"), patterns()):
        every += [(BIT[x], re.compile(y)) for y in alternatives(p.pattern)]
    out: dict[str, dict[int, tuple[bool, bool, bool]]] = {}
    for k, (_, p) in enumerate(every):
        for way in spelled(syntax.parse(p.pattern)):
            s = stem(way)
            w = s.replace(EDGE, "")
            if not w:
                raise ValueError(f"a voter's alternative without a stem: {way!r}")
            a, z = s[0] == EDGE and w[0].isalnum(), s[-1] == EDGE and w[-1].isalnum()
            whole = way == EDGE * a + w + EDGE * z
            mine = out.setdefault(w, {})
            if k in mine:
                whole = whole and mine[k] == (a, z, True)
                a, z = a and mine[k][0], z and mine[k][1]
            mine[k] = a, z, whole
    return every, {w: [(a, z, k, whole) for k, (a, z, whole) in mine.items()] for w, mine in out.items()}


@lru_cache(maxsize=1)
def automaton():
    """Finds all stems in one pass; gives their numbers in the order of ways()."""
    import ahocorasick

    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, w in enumerate(ways()[1]):
        out.add_word(w, k)
    out.make_automaton()
    return out


@lru_cache(maxsize=1)
def stems() -> list[tuple[int, list[tuple[bool, bool, int, bool]]]]:
    return [(len(w), x) for w, x in ways()[1].items()]


def voted(t: str) -> int:
    """The votes of single patterns on a normalised sentence; only alternatives with a stem in it are looked for."""
    every, stem_of, found, may, end_of_t = ways()[0], stems(), 0, set(), len(t) - 1
    for end, number in automaton().iter(t):
        n, asked = stem_of[number]
        before = end >= n and (t[end - n].isalnum() or t[end - n] == "_")
        behind = end < end_of_t and (t[end + 1].isalnum() or t[end + 1] == "_")
        for a, z, k, whole in asked:
            if not (a and before or z and behind):
                if whole:
                    found |= every[k][0]
                else:
                    may.add(k)
    for k in may:
        bit, p = every[k]
        if not found & bit and p.search(t):
            found |= bit
    return found


# Kinds of characters that many texts are asked for at once.
KINDS = {
    "letter": r"[^\W\d_]", "word": r"\w", "odd": ODD.pattern, "latin": "(?i:[a-zà-ÿ])", "cyrillic": "(?i:[\u0400-\u04ff])", "ends": "[!?。！？]", "stop": "[.!?]", "after": "[ \t\"”»’]", "line": r"[\r\n]", "dot": "[.]",
    "capital": "[A-ZÀ-Ý]", "a-z": "[a-z]", "small": "[a-zà-ÿ]", "leet": "[@$013457]", "leetable": "[a-zà-ÿ0-9@$]",
}


@lru_cache(maxsize=1)
def kinds() -> dict[str, np.ndarray]:
    """Which characters are of a kind."""
    every = "".join(map(chr, range(0x110000)))
    out = {}
    for name, p in KINDS.items():
        out[name] = np.zeros(len(every), bool)
        for m in re.finditer(f"(?:{p})+", every):
            out[name][m.start() : m.end()] = True
    return out


def codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def joined(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The texts in one, with a sign between them that no pattern asks for, one before and some behind, and where each begins and ends."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    return "\0".join(["", *texts, "\0\0\0"]), np.append(1, ends[:-1] + 1), ends


def plain_texts(texts: Sequence[str]) -> list[str]:
    """What plain gives for each text."""
    s, begins, _ = joined(texts)
    x, kind, out = codes(s), kinds(), list(texts)
    latin, cyrillic = kind["latin"][x], kind["cyrillic"][x]
    odd = np.flatnonzero(kind["odd"][x]), np.flatnonzero(latin[1:] & cyrillic[:-1] | latin[:-1] & cyrillic[1:])
    for k in np.unique(np.searchsorted(begins, np.concatenate(odd), "right") - 1).tolist():
        out[k] = plain(out[k])
    return out


class Parts:
    """All sentences of texts: the number of the text, where each begins and ends in the texts and in the normalised ones, whether it
    is marked and its votes. One with a stem of some voter or a disguise is marked: it may get any vote. Another gets none but those of
    WEAK, which are given, and only its normalised form is right, as it needs no more than what is done for the texts at once."""

    def __init__(self, texts: Sequence[str]):
        kind = kinds()
        texts = plain_texts(texts)
        self.text, begins, ends = joined(texts)
        low = self.text.lower()
        if len(low) != len(self.text):  # a letter whose small form is longer
            self.text, begins, ends = joined([t if len(t.lower()) == len(t) else t.lower() for t in texts])
            low = self.text.lower()
        x = codes(self.text)
        ends_at = kind["ends"][x]
        ends_at[1:] |= kind["stop"][x[:-1]] & kind["after"][x[1:]]
        line = kind["line"][x]
        ends_at[:-1] |= line[:-1] & ~line[1:]
        dots = np.flatnonzero(kind["dot"][x[:-2]])
        ends_at[dots[kind["capital"][x[dots + 1]] & kind["a-z"][x[dots + 2]]]] = True
        at = np.unique(np.concatenate((np.flatnonzero(ends_at) + 1, begins, ends)))
        at = at[: np.searchsorted(at, ends[-1], "right")]

        x = codes(low).copy()
        for k, t in unleeted(low, x):
            x[k : k + len(t)] = codes(t)
        keep = np.ones(len(x), bool)
        twice = np.flatnonzero(x[1:] == x[:-1]) + 1
        keep[twice[kind["letter"][x[twice]]]] = False
        x = x[keep]
        self.normal = x.tobytes().decode("utf-32-le", "surrogatepass")
        places = np.append(0, np.cumsum(keep))[at]
        bits, self.marked = self.looked_for(x, places)
        self.marked[np.searchsorted(at, [m.start() for p in HIDDEN for m in p.finditer(low)], "right") - 1] = True

        self.number = np.searchsorted(begins, at[:-1], "right") - 1
        own = np.flatnonzero(at[:-1] < ends[self.number])  # not what stands between the texts
        self.number, self.marked, self.votes = self.number[own], self.marked[own], bits[own]
        self.start, self.end, self.left, self.right = at[own], at[own + 1], places[own], places[own + 1]

    def looked_for(self, x: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The votes of WEAK and whether it is marked, of each part of the normalised text."""
        every = ways()[0]
        hits = np.fromiter(chain.from_iterable(automaton().iter(self.normal)), np.int64).reshape(-1, 2)
        end, number = hits[:, 0], hits[:, 1]
        length, first, n_asked, asked = stem_table()
        word = kinds()["word"]
        before, behind = word[x[end - length[number]]], word[x[end + 1]]
        n = n_asked[number]
        hit = np.repeat(np.arange(len(n)), n)
        a, z, k, whole = asked[np.repeat(first[number] - np.cumsum(n) + n, n) + np.arange(len(hit))].T
        right = ~(a & before[hit] | z & behind[hit]).astype(bool)
        part, k, whole = np.searchsorted(places, end[hit[right]], "right") - 1, k[right], whole[right] > 0
        bit = np.array([b if b & WEAK_BITS else 0 for b, _ in every])[k]
        bits, marked = np.zeros(len(places), np.int64), np.zeros(len(places), bool)
        marked[part[bit == 0]] = True
        np.bitwise_or.at(bits, part[whole], bit[whole])
        rest = ~whole & ~marked[part] & (bits[part] & bit == 0)
        for one in np.unique(part[rest] * len(every) + k[rest]).tolist():
            part, k = divmod(one, len(every))
            bit, p = every[k]
            if not bits[part] & bit and p.search(self.normal[places[part] : places[part + 1]]):
                bits[part] |= bit
        return bits, marked


WEAK_BITS = sum(BIT[x] for x in WEAK)


@lru_cache(maxsize=1)
def stem_table() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """stems() as arrays: lengths, the first row of each in the last array and how many it has, and these rows."""
    n = np.array([len(x) for _, x in stems()])
    return np.array([length for length, _ in stems()]), np.cumsum(n) - n, n, np.array([y for _, x in stems() for y in x], np.int64)


def unleeted(low: str, x: np.ndarray) -> Iterator[tuple[int, str]]:
    """Where unleet changes a text in small letters, and to what; only runs of characters with both a letter and a sign are looked at."""
    kind = kinds()
    step = np.flatnonzero(np.diff(kind["leetable"][x])) + 1  # the text begins and ends with something else
    begin, end = step[::2], step[1::2]
    small = np.append(0, np.cumsum(kind["small"][x]))
    run = np.unique(np.searchsorted(begin, np.flatnonzero(kind["leet"][x]), "right") - 1)
    for k in begin[run[small[end[run]] > small[begin[run]]]].tolist():
        m = LEETED.match(low, k)
        if m and unleet(m[0]) != m[0]:
            yield k, unleet(m[0])


def candidate_sentences(text: str) -> Iterator[str]:
    """The sentences with a stem of some voter or a disguise."""
    p = Parts([text])
    return (p.text[a:z] for a, z, marked in zip(p.start.tolist(), p.end.tolist(), p.marked.tolist()) if marked)


SEEN = sum(BIT[x] for x in ("insult", "strong", "hostile", "threat", "dehumanise", "sexual", "profane", "demean", "disguise"))


def votes_of_texts(texts: Sequence[str]) -> set[tuple[int, str, int]]:
    """(number of the text, normalised sentence, votes) of each text's distinct sentences."""
    p = Parts(texts)
    text, normal, memo, out = p.text, p.normal, {}, set()
    for k, start, end, left, right, marked, v in zip(*(x.tolist() for x in (p.number, p.start, p.end, p.left, p.right, p.marked, p.votes))):
        if marked:
            s = text[start:end]
            if s not in memo:
                memo[s] = votes(s)
            out.add((k, *memo[s]))
        else:
            t = normal[left:right]
            if not t.isspace():
                out.add((k, t, v))
    return out


def all_votes(text: str) -> set[tuple[str, int]]:
    """(normalised sentence, votes) of a text's distinct sentences."""
    return {(t, v) for _, t, v in votes_of_texts([text])}


def judged_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, s, v, f): of every row each distinct sentence's votes and features, and its normalised text s if some voter other than
    address, group and factual sees it."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("t").to_pylist()
            group = np.cumsum([len(t) for t in texts]) // TOGETHER
            for g in np.unique(group).tolist():
                first, last = np.searchsorted(group, [g, g + 1]).tolist()
                yield from judged(b.column("k").slice(first), votes_of_texts(texts[first:last]))

    def judged(keys: pa.Array, found: set[tuple[int, str, int]]) -> Iterator[pa.RecordBatch]:
        rows = list(found)
        for i in range(0, len(rows), GROUPED):
            at, s, v = zip(*rows[i : i + GROUPED])
            ids, sizes = features(s, v)
            f = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(ids.astype(np.int32)))
            said = pa.array([x if y & SEEN else None for x, y in zip(s, v)], pa.string())
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int32())), said, pa.array(v, pa.int32()), f], ["k", "s", "v", "f"])

    return spread(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL AND t <> ''")).mapInArrow(run, f"k {kind}, s string, v int, f array<int>")


CLASSES = ("none", "abusive", "hateful", "sexual")


class LabelModel:
    """Four classes; voter j says yes with probability p[c, j] in class c. Fitted by expectation maximisation to counts of vote
    patterns; labelled sentences, given as (pattern, class), count like EXAMPLES unlabelled ones each and set the start."""

    EXAMPLES = 3.0

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, labelled: list[tuple[int, int]], rounds: int = 60):
        bits, n = self.bits(patterns), counts.astype(float)
        mine = self.bits([v for v, _ in labelled])
        own = np.eye(len(CLASSES))[[c for _, c in labelled]].reshape(-1, len(CLASSES)) * self.EXAMPLES
        self.weight = np.ones(len(VOTERS))
        self.p = (own.T @ mine + START) / (own.sum(axis=0)[:, None] + 2 * START.max(axis=1)[:, None])
        self.prior = (own.sum(axis=0) + 1) / (own.sum() + len(CLASSES))
        for k in range(rounds):
            q = self.classes(bits)
            if k == rounds // 2:
                self.weight = self.shared(bits, n, q)
            w = q * n[:, None]
            self.prior = (w.sum(axis=0) + own.sum(axis=0) + 1) / (n.sum() + own.sum() + len(CLASSES))
            self.p = (w.T @ bits + own.T @ mine + START) / (w.sum(axis=0) + own.sum(axis=0) + 2 * START.max(axis=1))[:, None]

    @staticmethod
    def bits(patterns) -> np.ndarray:
        return (np.asarray(patterns, np.int64).reshape(-1, 1) >> np.arange(len(VOTERS)) & 1).astype(float)

    def shared(self, bits: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """1 / (1 + the correlation with other voters that the classes leave) of each voter."""
        total = np.zeros((bits.shape[1], bits.shape[1]))
        for c in range(len(CLASSES)):
            w = n * q[:, c]
            x = bits - self.p[c]
            cov = (x * w[:, None]).T @ x / max(w.sum(), 1)
            sd = np.sqrt(np.clip(np.diag(cov), 1e-4, None))
            total += cov / sd / sd[:, None] * w.sum() / n.sum()
        np.fill_diagonal(total, 0)
        return 1 / (1 + np.where(total > 0.2, total, 0).sum(axis=1))

    def classes(self, bits: np.ndarray) -> np.ndarray:
        p = np.clip(self.p, 0.03, 0.97)
        z = np.log(self.prior) + (bits * self.weight) @ np.log(p).T + ((1 - bits) * self.weight) @ np.log(1 - p).T
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def label(self, patterns) -> np.ndarray:
        """Posterior of any class but none."""
        return 1 - self.classes(self.bits(patterns))[:, 0]


# Pseudo-counts of yes votes: what each voter is meant for.
START = np.full((len(CLASSES), len(VOTERS)), 0.05)
for _c, _names in (("none", "factual"), ("abusive", "insult strong address hostile threat profane demean disguise insult+address"), ("hateful", "group dehumanise group+dehumanise"), ("sexual", "sexual")):
    for _n in _names.split():
        START[CLASSES.index(_c), VOTERS.index(_n)] = 1.0


def features(sentences: Sequence[str], votes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of each sentence's words, word pairs and votes, ascending, one sentence after the other, and how many each has; of
    Chinese, pairs of characters."""
    s, begins, _ = joined(sentences)
    x = codes(s)
    step = np.flatnonzero(np.diff(kinds()["letter"][x])) + 1  # a word's begin and its end in turn
    begin, size = step[::2], step[1::2] - step[::2]
    pairs = x[begin] >= ord("⺀")
    if pairs.any():
        n = np.where(pairs, np.maximum(size - 1, 1), 1)
        begin = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        size = np.repeat(np.where(pairs, np.minimum(size, 2), size), n)
    sizes = np.diff(np.searchsorted(begin, np.append(begins, len(x))))
    row = np.repeat(np.arange(len(sentences)), sizes)
    inside = np.flatnonzero(row[1:] == row[:-1])
    data, end = s.encode("utf-8", "surrogatepass"), begin + size
    if len(data) > len(x):
        place = np.append(0, np.cumsum(1 + (x >= 0x80) + (x >= 0x800) + (x >= 0x10000)))
        begin, end = place[begin], place[end]
    alone = checksums(data, begin, end - begin, np.zeros(len(begin), np.uint32))
    two = checksums(data, begin[inside + 1], (end - begin)[inside + 1], after(ord(" "), alone[inside] ^ ONES) ^ ONES)
    voted = np.nonzero(np.asarray(votes, np.int64)[:, None] >> np.arange(len(VOTERS)) & 1)
    every = np.concatenate((row * DIM + alone % (DIM - 64), row[inside] * DIM + two % (DIM - 64), voted[0] * DIM + DIM - 64 + voted[1]))
    every.sort()
    every = every[np.append(True, every[1:] != every[:-1])[: len(every)]]
    return every % DIM, np.bincount(every // DIM, minlength=len(sentences))


ONES, POLYNOMIAL = np.uint32(0xFFFFFFFF), 0xEDB88320
LONG = 48  # bytes of a word up to which many are summed at once


@lru_cache(maxsize=1)
def bytes_of_crc() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, out >> 1 ^ np.uint32(POLYNOMIAL), out >> 1).astype(np.uint32)
    return out


def after(byte: np.ndarray | int, crc: np.ndarray) -> np.ndarray:
    """Inverted CRCs carried on by a byte each."""
    return bytes_of_crc()[(crc ^ np.uint32(byte) if isinstance(byte, int) else crc ^ byte) & 255] ^ crc >> 8


def checksums(data: bytes, begin: np.ndarray, size: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """zlib.crc32 of stretches of data, carried on from crc."""
    x = np.frombuffer(data, np.uint8)
    order = np.argsort(np.minimum(size, LONG + 1).astype(np.uint8), kind="stable")[::-1]
    places, sizes, got = begin[order], size[order], crc[order] ^ ONES
    n_long = int(np.count_nonzero(size > LONG))
    for k in range(int(sizes[n_long]) if n_long < len(sizes) else 0):
        n = n_long + int(np.count_nonzero(sizes[n_long:] > k))
        got[n_long:n] = after(x[places[n_long:n] + k], got[n_long:n])
    got ^= ONES
    for k in range(n_long):
        got[k] = zlib.crc32(data[places[k] : places[k] + sizes[k]], int(crc[order[k]]))
    out = np.empty_like(got)
    out[order] = got
    return out


def train(rows: list[list[int]], y: np.ndarray, rounds: int = 300, ridge: float = 2e-3) -> np.ndarray:
    """Weights of a logistic regression on the features of sentences and soft labels, by gradient steps of a size set for each
    weight."""
    at = np.fromiter((i for r in rows for i in r), np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    size = np.array([max(len(r), 1) for r in rows], float)
    vote = at >= DIM - 64
    x = np.where(vote, 1.0, (1 / np.sqrt(size))[row])  # words count by the sentence's length, votes in full
    w, bias, seen, seen_b = np.zeros(DIM), 0.0, np.full(DIM, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.bincount(row, w[at] * x, len(rows)) + bias
        d = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(at, d[row] * x, DIM) / len(rows) + ridge * w / 100
        seen += g * g
        seen_b += d.mean() ** 2
        w -= 0.5 * g / np.sqrt(seen)
        bias -= 0.5 * d.mean() / np.sqrt(seen_b)
    return np.append(w, bias)


def scores(weights: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Scores of sentences from their features, one after the other, and from how many each has; 0 without any."""
    row, vote, w = np.repeat(np.arange(len(sizes)), sizes), ids >= DIM - 64, weights[ids]
    z = weights[-1] + np.bincount(row[vote], w[vote], len(sizes)) + np.bincount(row[~vote], w[~vote], len(sizes)) / np.sqrt(np.maximum(sizes, 1))
    return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), 0.0)


def scored(df: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """(key, score, n_sentences): of each row the score of its worst sentence and how many stand above the threshold.

    Every sentence is scored. examples has text and label (abusive, hateful, sexual, none) of at most a few thousand reference items;
    up to sample of them are used to train the classifiers, and up to sample each of the corpus's distinct sentences that a voter sees and of
    the others. A null and a text without letters score 0, and so do all if no voter sees any sentence, as then nothing can be learnt.
    Rows of one key count once.
    """
    kind = df.schema[key].dataType.simpleString()
    seen = staged(judged_sentences(df, key, text), "votes")
    labelled, own, own_y = [], [], []
    for r in examples.where("text IS NOT NULL").select("text", "label").limit(sample).collect():
        found = [votes(x) for x in SENTENCE.split(r["text"]) if x.strip()]
        c = CLASSES.index(r["label"]) if r["label"] in CLASSES else 0
        worst = max(found, key=lambda x: bin(x[1] & ~FACT).count("1"), default=None)
        for x in found:
            # Of an item that is a case only the sentence with most votes is taken for it.
            if c == 0 or x is worst:
                if x[1]:
                    labelled.append((x[1], c))
                own.append(features([x[0]], [x[1]])[0])
                own_y.append(float(c > 0))
    distinct = seen.where("s IS NOT NULL").select("s", "v", "f").distinct()
    counts = distinct.groupBy("v").agg(F.count("*").alias("n")).collect()
    keys = df.select(F.col(key).alias("key")).distinct()
    if not counts:
        return keys.select(F.col("key").alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("n_sentences"))
    model = LabelModel(np.array([r["v"] for r in counts]), np.array([r["n"] for r in counts]), labelled)

    # The driver gets at most sample lists of less than DIM numbers each, twice, however long the sentences are.
    rows = distinct.orderBy(F.xxhash64("s"), "s").limit(sample).select("f", "v").collect()
    y = model.label([r["v"] for r in rows])
    rows = [list(r["f"]) for r in rows] + own
    y = np.concatenate((y, own_y))
    weights = train(rows, y)
    # Nothing labels the others: the model knows how voters err where one speaks, not how often all are silent. They count as harmless, and
    # the second classifier tells them by the words they share with labelled ones.
    others = seen.where("s IS NULL").select("f")
    share = others.count() // (4 * sample) + 1
    silent = others.where(F.expr(f"pmod(xxhash64(f), {share}) = 0")).distinct().orderBy(F.xxhash64("f"), "f").limit(sample).collect()
    second = train(rows + [list(r["f"]) for r in silent], np.append(y, np.zeros(len(silent))))
    sent = df.sparkSession.sparkContext.broadcast((weights, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, voted = b.column("f"), b.column("voted").to_numpy(zero_copy_only=False)
            got = [scores(w, f.flatten().to_numpy(), np.diff(f.offsets.to_numpy())) for w in sent.value]
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(np.where(voted, *got))], ["k", "score"])

    worst = seen.select("k", "f", F.col("s").isNotNull().alias("voted")).mapInArrow(run, f"k {kind}, score double").groupBy("k").agg(F.max("score").alias("score"), F.count(F.when(F.col("score") >= THRESHOLD, 1)).cast("int").alias("n_sentences"))
    return keys.join(worst, F.col("key").eqNullSafe(F.col("k")), "left").select(F.col("key").alias(key), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"))


FACT = 1 << VOTERS.index("factual")


def rates(df: DataFrame, scores: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """(source, n_docs, n_flagged, rate): of each source the share of its documents at or above the threshold."""
    rows = df.select(key, source).dropDuplicates([key]).join(scores, key)
    out = rows.groupBy(source).agg(F.count("*").alias("n_docs"), F.count(F.when(F.col("score") >= THRESHOLD, 1)).alias("n_flagged"))
    return out.withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
