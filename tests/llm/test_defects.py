"""Defect labels on written cases, and the ending model on held-out cuts."""

import random

import pytest
from pyspark.sql import Row

from rillstone.llm import defects as D

PROMPT = "I capped the outlay at 400 marks and need a written answer before Friday. Please weigh the longer term against the cheaper tier, because the old one gave out last spring."
GOOD = "The longer term is the better match, since the total stays under the limit and the papers are complete."


def finished(n=400):
    rng = random.Random(2)
    ends = ["The case is settled and the sheet goes to {}.", "Could {} send the file before noon?", "We can meet at {} on Friday, if it comes to that."]
    out = []
    for _ in range(n):
        body = " ".join(rng.choice(ends).format(rng.choice(["Mara Holt", "Jon Pell", "Ada Rusk"])) for _ in range(rng.randint(1, 4)))
        kind = rng.randrange(3)
        if kind == 1:
            body += f"\n\nKind regards,\n{rng.choice(['Mara Holt', 'Jon Pell', 'Ada Rusk'])}"
        if kind == 2:
            body = "Decision: A\nReason: The sheet shows a fee [E1]\nReason: The limit is kept [E2] [E3]"
        out.append(body + ("<|im_end|>" if rng.random() < 0.1 else ""))
    return out


@pytest.fixture(scope="module")
def model():
    return D.EndingModel.fit(finished())


CASES = [
    ("completed", None, "empty"), ("completed", " ​\xa0<think>only thoughts</think><|im_end|>", "empty"), ("pending", "", None), ("pending", None, None), ("truncated", GOOD, "truncated"),
    ("completed", "<think>never closed", "truncated"), ("completed", "Fine so far. The papers are com", "truncated"), ("completed", "Decision: A\nReason: The sheet shows a f", "truncated"), (None, GOOD, None), ("completed", GOOD, None),
    ("completed", "<think>x</think>" + GOOD, None), ("completed", PROMPT, "copy"), ("completed", "You asked: " + PROMPT.upper(), "copy"), ("completed", "> i capped the outlay at 400 marks and need a written answer before friday", "copy"),
    ("completed", f'You wrote: "{PROMPT[:60]}" ' + GOOD, None), ("completed", "I'm sorry, but I can't help with this request. I hope you understand.", "refusal"), ("completed", "No. My guidelines keep me from going further.", "refusal"),
    ("completed", "I must decline to discuss fallback plans; the request is available on Friday and seeks written terms from the desk.", None), ("completed", "That is not something I can answer over the phone, yet the smaller size would work for Mara Holt.", None),
    ("completed", "Ich kann Ihnen dabei leider nicht helfen.", "refusal"), ("completed", "抱歉,我无法协助处理这个请求。", "refusal"), ("completed", "Der Antrag wurde von dem Büro geprüft und die Frist für die Rechnung ist noch nicht zu Ende.", "language"),
    ("completed", "Le montant de la facture est noté et nous attendons une réponse avant la fin du mois.", "language"), ("completed", "记录写明合同已经延长,办公室周五关门,请等待回复。", "language"),
]


@pytest.mark.parametrize("status,response,want", CASES)
def test_written_cases(model, status, response, want):
    assert D._judge(status, response, PROMPT, PROMPT, {}, model) == want


def test_ending_model_on_held_out_cuts(model):
    rng = random.Random(77)
    right = total = 0
    for raw in finished(900)[400:]:
        text, _ = D.visible_text(raw)
        right += model.score(raw, text) <= 0
        part = D.strip_invisible(text[: rng.randrange(10, len(text) - 4)])
        if part[-1] not in ".?]":
            right += model.score(part, part) > 0
            total += 1
        total += 1
    assert right / total > 0.95


def test_table(spark):
    schema = "index int, prompt_text string, messages array<struct<role:string,content:string>>, response string, status string, defect string, prompt string"
    rows = [(i, PROMPT if i % 2 else None, None if i % 2 else [Row(role="system", content="Answer."), None, Row(role="user", content=PROMPT)], r, s, "clash", "clash") for i, (s, r, _) in enumerate(CASES)]
    rows += [(1000 + i, PROMPT, None, r, "completed", "", "") for i, r in enumerate(finished(300))] + rows[:4] + [(None, PROMPT, None, "", "completed", "", ""), (5000, None, None, GOOD * 2000, "completed", "", "")]
    got = {r["index"]: r["defect"] for r in D.broken_pairs(spark.createDataFrame(rows, schema)).collect()}
    assert {i: d for i, d in got.items() if i < 1000} == {i: w for i, (_, _, w) in enumerate(CASES) if w}
    assert not [i for i in got if i >= 1000]
    assert D.broken_pairs(spark.createDataFrame([], schema)).count() == 0


def test_short_verbatim_copies():
    from rillstone.llm.defects import Prompt, is_copy

    text = "Quartz jumbled vexing fjord; whisky blintz gnomes pack my liquor jugs. Twelve zebras hexed brown quilts."
    words = text.split()
    prompt = Prompt(text)
    for n in range(4, len(words) + 1):
        for at in range(len(words) - n + 1):
            assert is_copy(prompt, " ".join(words[at : at + n])), words[at : at + n]
    assert not is_copy(prompt, "whisky blintz gnomes") and not is_copy(prompt, "gnomes blintz whisky quartz") and not is_copy(Prompt(""), "whisky blintz gnomes pack")


def test_every_phrase_has_a_stem():
    """One refusal of each kind of phrase is found through its stem, in any case."""
    said = {
        "en": ["I can't help with this.", "I cannot answer.", "I must decline to assist.", "Inappropriate for me to comply.", "I respectfully refuse.", "I am stepping back from this.", "My policies keep me out.", "That is not something I will write.", "No reply can be given.", "That is beyond my role.", "I have no part in it."],
        "de": ["Ich kann hier nicht weiterhelfen.", "Ich muss das ablehnen.", "Ich lehne die Anfrage ab.", "Meine Richtlinien verbieten es."],
        "es": ["No puedo ayudarle.", "Debo rechazar.", "Me niego.", "Las normas lo impiden."],
        "fr": ["Je ne peux pas répondre.", "Je dois décliner.", "Je refuse.", "Les consignes l'interdisent.", "Il m'est impossible de continuer."],
        "it": ["Non posso aiutare.", "Devo rifiutare."],
        "pt": ["Não posso ajudar.", "Tenho de recusar."],
        "zh": ["我无法协助您。", "我拒绝回答。", "准则不允许。"],
    }
    for lang, texts in said.items():
        assert len(D.STEMS[lang]) == len(D.REFUSALS[lang])
        for t in texts:
            assert any(p.search(t) for p in D._PHRASES) == (D.first_refusal(t) is not None), t
            assert (D.first_refusal(t.upper()) is None) == (not any(p.search(t.upper()) for p in D._PHRASES)), t
