"""Problem 3: prompts with empty, truncated, refusing, copied or wrong-language responses.

Each row is judged by itself in Arrow batches: copies by compressing the response with its
prompt as a zstandard dictionary (then confirmed word by word), refusals and languages by
dictionaries, broken-off endings by a model of the terminal context. That model is fitted on
a bounded sample of finished responses and on the same responses cut at random places.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstone.session import spread

#: Precedence: the first of these that holds is a sample's defect.
DEFECTS = ("empty", "truncated", "copy", "refusal", "language")

#: Chat stop tokens.
STOP_TOKENS = ("<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|end_of_text|>", "<|end|>", "<|user|>", "<|observation|>", "<|assistant|>", "</s>", "<eos>", "<end_of_turn>")
_STOP = re.compile("|".join(map(re.escape, STOP_TOKENS)))
_BLOCK = re.compile(r"<think(?:ing)?>.*?</think(?:ing)?>", re.S | re.I)
_OPEN, _CLOSE = re.compile(r"<think(?:ing)?>", re.I), re.compile(r"</think(?:ing)?>", re.I)


def strip_invisible(text: str) -> str:
    """Without white space, control, format and other characters that show nothing, at both ends."""
    lo, hi = 0, len(text)
    hidden = lambda ch: ch.isspace() or unicodedata.category(ch) in ("Cc", "Cf", "Zs", "Zl", "Zp", "Cn") or ch in "⠀ㅤᅟᅠ️"
    while lo < hi and hidden(text[lo]):
        lo += 1
    while hi > lo and hidden(text[hi - 1]):
        hi -= 1
    return text[lo:hi]


def visible_text(response: str) -> tuple[str, bool]:
    """What a reader sees, and whether a thinking block was never closed."""
    if "<" not in response:
        return strip_invisible(response), False
    text = _BLOCK.sub("", response)
    opened = _OPEN.search(text)
    unclosed = opened is not None
    if unclosed:
        text = text[: opened.start()]
    else:
        closes = list(_CLOSE.finditer(text))
        if closes:
            text = text[closes[-1].end() :]
    return strip_invisible(_STOP.sub("", text)), unclosed


# --- languages -----------------------------------------------------------------------------

#: Frequent function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in is for with that on was at by from it are as be this have has an not which or but can will would we you my if so no our your their they he she there what when who how does do than then about after before",
    "de": "der die das und ist nicht von mit für wurde dass aus ein eine einen einem einer nach auf dem den des zu im wir sie er es bei wird werden haben hat noch oder aber wenn weil als auch nur um bis sich ohne über unter vor wie am zum zur kein keine ich",
    "es": "el la los las de que y por con para fue está están en un una se del al no es son como más si ya lo le su sus sin sobre entre cuando porque pero hay esta este solo también muy tras antes hasta nadie todavía",
    "fr": "le la les de et est pour avec que dans une un a été du des au aux sur par ne pas plus qui se ce cette il elle nous vous ils en sous si car mais ou donc avant après sans encore leur son sa ses sont y comme il",
    "it": "il lo la gli le di che e per con della del delle dei una un è sono non in nel nella da dal alla al si come più ma anche perché se questo questa prima dopo senza ancora",
    "pt": "o a os as de que e para com do da dos das em no na um uma não é são por se mais como mas foi ao à pelo pela sem sobre entre quando porque também já ainda",
    "nl": "de het een en van is niet dat met voor op te in zijn er aan door om bij als ook maar of wordt werd naar uit nog dan wel geen wij zij ik",
}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LANGUAGES_OF = {w: tuple(k for k, s in _SETS.items() if w in s) for w in frozenset().union(*_SETS.values())}
_SCRIPTS = {
    "zh": regex.compile(r"\p{Han}"), "ja": regex.compile(r"[\p{Hiragana}\p{Katakana}]"), "ko": regex.compile(r"\p{Hangul}"), "ru": regex.compile(r"\p{Cyrillic}"),
    "ar": regex.compile(r"\p{Arabic}"), "el": regex.compile(r"\p{Greek}"), "he": regex.compile(r"\p{Hebrew}"), "hi": regex.compile(r"\p{Devanagari}"), "th": regex.compile(r"\p{Thai}"),
}
_LETTERS, _ASCII_LETTERS = regex.compile(r"\p{L}+"), re.compile("[a-z]+")


def language_scores(text: str) -> dict[str, float]:
    """Evidence per language: function words of Latin scripts, and half the characters of others."""
    scores = dict.fromkeys(_SETS, 0.0)
    lower = text.lower()
    for w in (_ASCII_LETTERS if lower.isascii() else _LETTERS).findall(lower):
        if w in _LANGUAGES_OF:
            for k in _LANGUAGES_OF[w]:
                scores[k] += 1
    if not text.isascii() and max(text) >= "\u0370":  # below stand Latin letters only
        for k, p in _SCRIPTS.items():
            n = len(p.findall(text))
            if n:
                scores[k] = scores.get(k, 0.0) + n / 2
        if scores.get("ja"):
            scores["ja"] += scores.pop("zh", 0.0)
    return scores


def language_of(text: str) -> str | None:
    """The language with the most evidence; None where it is thin or a second one is close."""
    return leader(language_scores(text))


def leader(scores: dict[str, float], least: float = 2.0, lead: float = 1.5) -> str | None:
    ranked = sorted(scores.items(), key=lambda kv: (-kv[1], kv[0]))
    (best, n), (_, m) = ranked[0], ranked[1]
    return best if n >= least and n >= lead * m else None


@lru_cache(256)
def prompt_language(prompt: str) -> str | None:
    """As language_of; neighbouring samples share their prompt."""
    return language_of(prompt)


_QUOTED = re.compile(r"[\"“„«][^\"”“»]{8,}[\"”“»]")
_PROTOCOL = re.compile(r"^[*\s]*(?:decision|reason)\s*:\s*(?:\**\s*(?:[a-c]|none)\b)?|\[e\d+\]", re.I | re.M)


def other_language(prompt: str, response: str) -> bool:
    """Whether the response's prose, without quotations and line labels, is in another language."""
    asked = prompt_language(prompt)
    if not asked:
        return False
    prose = _QUOTED.sub(" ", response) if any(q in response for q in "\"“„«") else response
    if ":" in prose or "[" in prose:
        prose = _PROTOCOL.sub(" ", prose)
    own = language_scores(prose)
    got = leader(own)
    return got is not None and got != asked and own[got] >= 2 * own.get(asked, 0.0)


# --- refusals ------------------------------------------------------------------------------

#: Phrases by which a writer declines the task, by language. They name the task (help,
#: answer, write, choose ...), not one topic.
REFUSALS = {
    "en": (
        r"(?:can(?:no|')?t|cannot|can not|could not|couldn't|won't|will not|am (?:not able|unable) to|(?:'m|am) not going to|unable to|not able to|not in a position to|not willing to|unwilling to|(?:must|have to|need to) (?:decline|refuse) to|decline to|refuse to|rather not|prefer not to|not allowed to|not permitted to|not comfortable|wrong (?:for me )?to|not right for me to|inappropriate (?:for me )?to)"
        r"\s+(?:be\s+|even\s+|really\s+|simply\s+|possibly\s+|to\s+)*(?:help(?:ing)?|assist(?:ing)?|comply(?:ing)?|answer(?:ing)?|respond(?:ing)?|reply(?:ing)?|writ(?:e|ing)|draft(?:ing)?|produc(?:e|ing)|compos(?:e|ing)|generat(?:e|ing)|creat(?:e|ing)|choos(?:e|ing)|pick(?:ing)?|decid(?:e|ing)|act(?:ing)?|tak(?:e|ing) (?:part|on|sides)|participat(?:e|ing)|engag(?:e|ing)|continu(?:e|ing)|proceed(?:ing)?|go(?:ing)? (?:any )?further|do(?:ing)? (?:this|that|so|it)|complet(?:e|ing)|fulfil(?:l|ling)?|carry(?:ing)? (?:this|that|it) out|provid(?:e|ing)|giv(?:e|ing)|support(?:ing)?|handl(?:e|ing)|advis(?:e|ing)|recommend(?:ing)?|judg(?:e|ing)|speak(?:ing)?|serv(?:e|ing)|work(?:ing)? on)\b",
        r"(?:must|have to|need to|will|am going to|would like to|i) (?:respectfully |politely )?(?:decline|refuse)(?: (?:this|that|the|your) (?:task|request|question|message|choice))?(?=[\s]*[.!;,]|$)",
        r"\b(?:step|stepping|stand|bow|back) (?:back|away|aside|out|down) (?:from|of) (?:this|that|the|it)\b",
        r"\b(?:guidelines?|polic(?:y|ies)|principles|rules|instructions|training)\b[^.;]{0,40}\b(?:keep|keeps|prevent|prevents|stop|stops|forbid|forbids|bar|bars|do(?:es)? not (?:allow|let|permit)|don't (?:allow|let|permit)|doesn't (?:allow|let|permit)|prohibit|prohibits)\b",
        r"\b(?:not|isn't) something (?:that )?i (?:will|can|could|may|am able to|am willing to|want to|should) (?:write|do|produce|help|assist|draft|create|provide|support|take on|be part of|answer)\b",
        r"\bno (?:reply|answer|response|message|text|choice|help) (?:of mine |from me )?(?:can|will|could|may) be (?:given|made|offered|written|provided)\b",
        r"\b(?:outside|beyond) (?:of )?(?:what i (?:can|may|am able to)|my (?:role|remit|scope|abilities))\b",
        r"\bi (?:have|want) no part in (?:it|this)\b|\bthis (?:task|request) is (?:refused|declined)\b|\bcount me out\b|\bi(?: am|'m) out\b",
    ),
    "de": (r"(?:kann|darf|werde|möchte|will) (?:ich )?(?:\w+ ){0,4}(?:nicht|keine?n?) (?:\w+ ){0,4}(?:helfen|beantworten|antworten|schreiben|verfassen|entscheiden|weiterhelfen|erfüllen|übernehmen|unterstützen|tun|geben)", r"\b(?:muss|möchte) (?:ich )?(?:\w+ ){0,4}ablehnen\b", r"\blehne (?:ich )?(?:diese|die|den|das)? ?(?:anfrage|aufgabe|bitte)?\s*(?:ab)\b", r"richtlinien [^.]{0,40}(?:nicht|verbieten|hindern)"),
    "es": (r"\bno (?:puedo|podré|debo|voy a|quiero|me es posible|estoy en condiciones de)\s+(?:\w+ ){0,2}(?:ayudar|ayudarle|ayudarte|responder|contestar|escribir|redactar|elegir|decidir|continuar|seguir|hacer|hacerlo|participar|asistir)", r"\b(?:debo|tengo que|prefiero) (?:declinar|rechazar|negarme)", r"\bme niego\b", r"(?:normas|directrices|políticas?) [^.]{0,40}(?:impiden|impide|permiten|permite|prohíben)"),
    "fr": (r"\bje ne (?:peux|puis|pourrai|souhaite|veux|dois) (?:pas )?(?:\w+ ){0,3}(?:aider|répondre|écrire|rédiger|choisir|décider|continuer|faire|participer|donner suite|traiter)", r"\bje (?:dois|préfère) (?:décliner|refuser)", r"\bje (?:refuse|décline)\b", r"(?:règles|consignes|directives) [^.]{0,40}(?:empêchent|interdisent|permettent pas)", r"\bil m'est impossible de"),
    "it": (r"\bnon (?:posso|potrò|devo|voglio) (?:\w+ ){0,2}(?:aiutar|aiutare|rispondere|scrivere|scegliere|decidere|continuare|farlo)", r"\bdevo (?:declinare|rifiutare)"),
    "pt": (r"\bnão (?:posso|poderei|devo|vou) (?:\w+ ){0,2}(?:ajudar|responder|escrever|escolher|decidir|continuar|fazer)", r"\btenho de (?:recusar|declinar)"),
    "zh": (r"(?:无法|不能|不便|不会|不可以|恕不|恕难)(?:为您|为你|就此|对此|再|继续)?(?:协助|帮助|帮忙|回答|回复|提供|继续|撰写|代写|完成|处理|选择|参与|从命)", r"(?:拒绝|谢绝)(?:回答|回复|协助|此|这|该)", r"(?:准则|规定|政策)[^。]{0,12}(?:不允许|禁止|不许)"),
}
#: What a text must hold, in lower case, for the phrases above to be worth looking for, in their order.
STEMS = {
    "en": (
        "can't cannot cant can|not could|not couldn't won't will|not unable|to able|to not|going position|to willing|to decline refuse rather|not prefer|not not|allowed not|permitted not|comfortable wrong not|right inappropriate",
        "decline refuse", "back|from back|of away|from away|of aside|from aside|of out|from out|of down|from down|of", "guideline policy policies principles rules instructions training", "something",
        "be|given be|made be|offered be|written be|provided", "outside beyond", "no|part is|refused is|declined count|me am|out i'm|out",
    ),
    "de": ("helfen antworten schreiben verfassen entscheiden erfüllen übernehmen unterstützen tun geben", "ablehnen", "lehne", "richtlinien"),
    "es": ("no|p no|d no|v no|q no|me no|e", "declinar rechazar negarme", "niego", "normas directrices politica política"),
    "fr": ("je|ne", "décliner refuser", "refuse décline", "règles consignes directives", "impossible"),
    "it": ("non|p non|d non|v", "declinare rifiutare"),
    "pt": ("não|p não|d não|v", "recusar declinar"),
    "zh": ("无法 不能 不便 不会 不可以 恕不 恕难", "拒绝 谢绝", "准则 规定 政策"),
}
_PHRASES = [re.compile(p, re.I) for ps in REFUSALS.values() for p in ps]


def _stem_automaton() -> ahocorasick.Automaton:
    """Finds the stems in one scan; each says which phrases it may belong to."""
    of: dict[str, set[int]] = {}
    for i, stems in enumerate(x for lists in STEMS.values() for x in lists):
        for stem in stems.split():
            of.setdefault(stem.replace("|", " "), set()).add(i)
    found = ahocorasick.Automaton()
    for stem, which in of.items():
        found.add_word(stem, tuple(which))
    found.make_automaton()
    return found


_STEMS = _stem_automaton()


def first_refusal(sentence: str) -> re.Match | None:
    """The leftmost refusing phrase; only phrases whose stem stands in the text are looked for."""
    which = {i for _, found in _STEMS.iter(sentence.lower()) for i in found}
    hits = [m for i in sorted(which) if (m := _PHRASES[i].search(sentence))]
    return min(hits, key=lambda m: m.start()) if hits else None


#: What a sentence after a refusal says when it carries nothing.
_CLOSING = re.compile(
    r"hope (?:you|this|that)|understand|consult|professional|qualified|expert|another (?:tool|service|person|source)|someone else|suit you|anything else|something (?:different|else)|let me know|leave it (?:there|at that)|leave (?:this|that|it)\b|thank|sorry|apolog|regret|unfortunately|feel free|reach out|best wishes|kind regards|sincerely|verständnis|fachmann|fachperson|comprensión|profesional|compréhension|professionnel|谅解|理解|咨询|专业",
    re.I,
)
_CONTRAST = re.compile(r"[,;:–—-]\s*(?:but|yet|though|although|however|still|while|what (?:stands|i can)|the (?:request|file|offer)|instead|we can|i can)\b", re.I)
_LEAD = re.compile(r"^(?:dear\b|hello\b|hi\b|decision\s*:|re(?:garding)?\b|about\b|subject\b|to whom\b|liebe|sehr geehrte|estimad|cher|madame|尊敬)", re.I)
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|(?<=[。！？])|\n+")


def is_refusal(text: str) -> bool:
    """Whether the text declines its task. Withholding one point while going on is none: a refusing
    clause must not turn to an offer, and the other sentences must not carry the task on."""
    plain = text.replace("’", "'").replace("`", "'")
    if not first_refusal(plain):
        return False
    declined, carried = False, 0
    for s in filter(None, (x.strip() for x in _SENTENCE.split(plain))):
        m = first_refusal(s)
        words = len(s.split()) if s.isascii() or " " in s else len(s) // 2
        if m and not _turns_to_offer(s[m.end() :]):
            declined = True
        elif m or (words >= 7 and not _CLOSING.search(s) and not _LEAD.match(s)):
            carried += 1
    return declined and carried <= 1


def _turns_to_offer(rest: str) -> bool:
    m = _CONTRAST.search(rest)
    return bool(m and len(rest[m.end() :].split()) >= 4 and not _CLOSING.search(rest[m.end() :]))


# --- copies --------------------------------------------------------------------------------

_TOKEN, _ASCII_TOKEN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{N}]+"), re.compile("[a-z0-9]+")


def plain_words(text: str) -> list[str]:
    if text.isascii():
        return _ASCII_TOKEN.findall(text.lower())
    return _TOKEN.findall(unicodedata.normalize("NFKC", text).lower())


class Prompt:
    """A prompt's words and the zstandard dictionary made of them when it is first asked for."""

    def __init__(self, text: str):
        self.words = plain_words(text)
        self.own = frozenset(self.words)
        self.joined = f" {' '.join(self.words)} "
        self.known: dict[int, set[tuple[str, ...]]] = {}
        self.compressor: zstandard.ZstdCompressor | None = None
        self.frame = 0

    def ratio(self, words: list[str]) -> float:
        """Compressed size of the words with the prompt as dictionary, without the frame, per byte."""
        raw, book = " ".join(words).encode(), self.joined[1:-1].encode()
        if len(book) < 8 or not raw:
            return 1.0
        if self.compressor is None:
            # The window reaches over the whole prompt and the response.
            wide = max(20, min(zstandard.WINDOWLOG_MAX, (len(book) + len(raw)).bit_length()))
            how = zstandard.ZstdCompressionParameters.from_level(3, window_log=wide, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.compressor = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(book, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            self.frame = len(self.compressor.compress(b""))
        return (len(self.compressor.compress(raw)) - self.frame) / len(raw)

    def covered(self, words: list[str], run: int) -> int:
        """How many words stand in stretches of at least `run` words that the prompt holds too."""
        run = min(run, len(words))
        if run not in self.known:
            self.known[run] = set(zip(*(self.words[i:] for i in range(run))))
        total = upto = 0
        for i, gram in enumerate(zip(*(words[i:] for i in range(run)))):
            if gram in self.known[run]:
                total += i + run - max(i, upto)
                upto = i + run
        return total


def is_copy(prompt: Prompt, text: str, ratio: float = 0.6, share: float = 0.75, run: int = 4, least: int = 4) -> bool:
    """Whether the text only gives prompt text back: it compresses to a `ratio` with the prompt as
    dictionary, and at least a `share` of its words stand in prompt runs, or all but a short lead-in. Words
    that stand in the prompt in one run need no ratio; fewer than `least` are an answer, not a copy."""
    words = plain_words(text)
    if len(words) < least:
        return False
    # What runs can cover is at most what the prompt's words hold at all.
    held = len([w for w in words if w in prompt.own])
    if held < share * len(words) and (held < 12 or len(words) - held > 6):
        return False
    if f" {' '.join(words)} " in prompt.joined:
        return True
    if prompt.ratio(words) > ratio:
        return False
    got = prompt.covered(words, run)
    return got >= share * len(words) or (got >= 12 and len(words) - got <= 6)


# --- endings -------------------------------------------------------------------------------

_END = ".!?。！？…"
_SENTENCES_BEFORE = re.compile(r".*(?:[.!?。！？]\s+|。)", re.S)
_LABEL, _CITED, _DECISION = re.compile(r"[*\s]*([A-Za-z]{4,12}):"), re.compile(r"\[E\d+\]\.?$"), re.compile(r"^[*\s]*decision\s*:", re.I | re.M)


def ending_features(raw: str, text: str) -> list[str]:
    """The terminal context of a response."""
    line = text.rsplit("\n", 1)[-1].strip()
    lines = text.rsplit("\n", 2)
    previous = lines[-2].strip() if len(lines) > 1 else ""
    stripped = line.rstrip("*_\"'”’)»")
    last = stripped[-1:] or "none"
    kind = last if not last.isalnum() else "digit" if last.isdigit() else "letter"
    whole = stripped.rstrip(_END)
    before = _SENTENCES_BEFORE.match(whole)
    words = whole[before.end() if before else 0 :].split()
    label = _LABEL.match(line) if ":" in line else None
    protocol = ":" in text and bool(_DECISION.search(text))
    cited = "]" in stripped[-2:] and bool(_CITED.search(stripped))
    size = min(len(words), 3) if len(words) < 4 else 4 if len(words) < 9 else 5
    word = re.sub(r"\d", "0", words[-1].lower().strip(_END)) if words else ""
    signed = previous.endswith(",") and len(previous.split()) <= 4 and len(line.split()) <= 6
    return [
        f"kind={kind}", f"kind={kind},protocol={protocol},label={label.group(1).lower() if label else ''},cited={cited}",
        f"signed={signed},kind={kind if kind not in 'letterdigit' else 'word'},size={size if signed else ''}",
        f"stop={'<' in raw[-40:] and bool(_STOP.search(raw[-40:]))}", f"size={size},kind={kind}", f"word={word if kind in ('letter', 'digit') and signed else kind}", f"label={bool(label)},kind={kind},size={min(size, 2)}",
    ]


@dataclass
class EndingModel:
    """A logistic model of the terminal context: above 0 the response was cut short."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    def score(self, raw: str, text: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in ending_features(raw, text))

    @staticmethod
    def fit(responses: list[str], seed: int = 5, rounds: int = 400) -> "EndingModel":
        """From finished responses and the same ones cut at random places inside a sentence."""
        rng = random.Random(seed)
        rows: list[list[str]] = []
        for raw in responses:
            text, unclosed = visible_text(raw)
            if unclosed or len(text) < 24:
                continue
            for _ in range(4):
                at = rng.randrange(max(8, len(text) // 5), len(text) - 2)
                part = strip_invisible(text[:at])
                if part and part[-1] not in _END and not re.search(r"\[E\d+\]$", part):
                    rows += [ending_features(raw, text), ending_features(part, part)]
                    break
        seen = Counter(f for r in rows for f in r)
        names = sorted(f for f, n in seen.items() if n > 4)
        if not names:
            return EndingModel()
        place = {f: i for i, f in enumerate(names)}
        # Equal contexts are one weighted row.
        counts = Counter((tuple(sorted(place[f] for f in set(r) if f in place)), i % 2) for i, r in enumerate(rows))
        x = np.zeros((len(counts), len(names) + 1))
        x[:, -1] = 1
        for i, (own, _) in enumerate(counts):
            x[i, list(own)] = 1
        y = np.array([label for _, label in counts], float)
        share = np.array(list(counts.values())) / len(rows)
        w = np.zeros(x.shape[1])
        for _ in range(rounds):  # plain gradient steps with a little shrinkage
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= 2.0 * (x.T @ ((p - y) * share) + 1e-4 * w)
        return EndingModel({f: float(w[i]) for f, i in place.items()}, float(w[-1]))


# --- one sample ----------------------------------------------------------------------------


def defect_of(status: str | None, response: str | None, prompt: str, prompts: dict[str, Prompt], model: EndingModel) -> str | None:
    """The defect of a sample, or None.

    Pending samples have none. A null response is empty. A null status says nothing. With an
    empty prompt neither copies nor languages can be told.
    """
    status = (status or "").strip().lower()
    if status == "pending":
        return None
    text, unclosed = visible_text(response or "")
    if not text and not unclosed:
        return "empty"
    if unclosed or status == "truncated":
        return "truncated"
    if prompt:
        if prompt not in prompts:
            if len(prompts) > 64:
                prompts.clear()
            prompts[prompt] = Prompt(prompt)
        if is_copy(prompts[prompt], text):
            return "copy"
    if is_refusal(text):
        return "refusal"
    if prompt and other_language(prompt, text):
        return "language"
    return "truncated" if model.score(response or "", text) > 0 else None


def prompt_of(prompt_text: str | None, messages: list[dict] | None) -> tuple[str, str]:
    """The user's words (for the language) and all the words shown (for copies)."""
    said = [m for m in messages or () if m and m.get("content")]
    users = [m["content"] for m in said if (m.get("role") or "").lower() == "user"]
    user = "\n".join(users) or (prompt_text or "") or "\n".join(m["content"] for m in said)
    everything = "\n".join(dict.fromkeys([*(m["content"] for m in said), *([prompt_text] if prompt_text else [])]))
    return user, everything


def broken_pairs(samples: DataFrame, fit_rows: int = 6000) -> DataFrame:
    """(index, defect) of each faulty sample, once.

    samples: index, prompt_text, messages, response, status; other columns are ignored. The ending
    model is fitted on at most `fit_rows` completed responses of at most 20000 characters, taken in
    the order of a hash; all rows are judged whole. Redelivered rows count once; of differing rows of one index the first defect
    in the order empty, truncated, copy, refusal, language stands. Rows without an index are left
    out. An empty table gives no row.
    """
    finished = samples.where("lower(trim(status)) = 'completed' and length(response) between 1 and 20000").select("response", F.xxhash64("index", "response").alias("h"))
    model = EndingModel.fit([r.response for r in finished.orderBy("h").limit(fit_rows).collect()])
    rank = {d: i for i, d in enumerate(DEFECTS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prompts: dict[str, Prompt] = {}
        for batch in batches:
            index, defect = [], []
            for row in zip(*(batch.column(c).to_pylist() for c in ("index", "prompt_text", "messages", "response", "status"))):
                user, everything = prompt_of(row[1], row[2])
                d = _judge(row[4], row[3], user, everything, prompts, model)
                if d:
                    index.append(row[0])
                    defect.append(rank[d])
            yield pa.RecordBatch.from_arrays([pa.array(index, pa.int32()), pa.array(defect, pa.int32())], ["index", "defect"])

    found = spread(samples.select(F.col("index").cast("int"), "prompt_text", "messages", "response", "status").where("index is not null")).mapInArrow(run, "index int, defect int")
    return found.groupBy("index").agg(F.min("defect").alias("d")).select("index", F.element_at(F.array(*map(F.lit, DEFECTS)), F.col("d") + 1).alias("defect"))


def _judge(status: str | None, response: str | None, user: str, everything: str, prompts: dict[str, Prompt], model: EndingModel) -> str | None:
    found = defect_of(status, response, everything, prompts, model)
    if found == "language" and not other_language(user, visible_text(response or "")[0]):
        return "truncated" if model.score(response or "", visible_text(response or "")[0]) > 0 else None
    return found
