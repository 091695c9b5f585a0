"""Refusals in words that were written down after the grammar: most must be found, and hardly any statement taken for one."""

import re

from citeweave.llm.pairs import judge
from citeweave.llm.refusals import declines

REFUSALS = [
    "I'm afraid I have nothing to offer on this.", "The passages shed no light on your question.", "Nothing in the library addresses this.", "I could not locate anything relevant to your query.", "The retrieved text does not speak to this point.", "Regrettably, I lack the information needed to respond.",
    "We cannot provide an answer based on the supplied excerpts.", "That is beyond my knowledge.", "I must refrain from commenting on this matter.", "None of the sources mention this.", "The documents provided fail to address the question.", "I have no idea.", "It is impossible to determine this from the excerpts.", "There is no mention of this in the papers I was given.",
    "The question cannot be resolved with the available material.", "Sorry, I won't be able to assist with this request.", "The library holds no papers on this subject.", "I am not aware of any passage that covers this.", "Your question is not answered anywhere in the collection.", "No answer could be found in the retrieved passages.", "The excerpts offer insufficient detail to reply.", "I'd prefer not to speculate.", "This topic isn't touched upon in the sources.", "I don't have access to that information.",
    "Darüber geben die Quellen keine Auskunft.", "Das kann ich nicht beurteilen.", "Ich habe dazu nichts gefunden.", "Leider weiß ich das nicht.", "Die Auszüge schweigen zu diesem Thema.", "Hierzu fehlen mir die nötigen Informationen.", "Diese Frage lässt sich mit dem vorliegenden Material nicht klären.", "Ich muss diese Anfrage leider ablehnen.", "In den Dokumenten wird das nicht erwähnt.", "Es gibt in der Bibliothek keine Angaben darüber.", "Dazu möchte ich mich nicht äußern.",
    "No tengo datos sobre esta cuestión.", "Las fuentes no mencionan este tema.", "Desconozco la respuesta.", "No me es posible contestar con el material disponible.", "Ninguno de los documentos aborda esta pregunta.", "Prefiero no opinar al respecto.", "Eso queda fuera del alcance de los artículos.", "No he encontrado nada sobre ello.", "Me niego a responder a esto.", "Los pasajes guardan silencio sobre este punto.",
    "Je n'ai trouvé aucune information à ce sujet.", "Les sources ne mentionnent pas cette question.", "Je l'ignore.", "Cela dépasse le cadre des documents fournis.", "Il m'est impossible de répondre à cette demande.", "Aucun passage ne traite de ce point.", "Je préfère ne pas me prononcer.", "Je ne dispose d'aucun élément sur ce thème.", "Les extraits restent muets sur cette question.", "Je ne suis pas en mesure de vous aider.",
]
STATEMENTS = [
    "The method does not need labels.", "The model cannot be trained without a large corpus.", "No improvement was seen on the second benchmark.", "There is little evidence that depth matters for short texts.", "The authors do not release their code.", "Accuracy drops outside the training domain.", "We found no difference between the two losses.", "Neither the encoder nor the decoder is frozen.", "It is hard to tell the two clusters apart by distance alone.",
    "The limits are that it does not scale and that it fails on noisy input.", "Nothing but the learning rate was changed.", "The sources of error are noise and drift.", "Graphs without cycles are not covered by the theorem.", "The approach is unable to separate near duplicates.",
    "Die Methode braucht keine Labels.", "Ohne Vorwissen sinkt die Genauigkeit nicht.", "Das Modell kann lange Texte nicht verarbeiten.", "Es gibt keinen Unterschied zwischen beiden Verfahren.", "El modelo no necesita etiquetas.", "No hay diferencias entre los dos grupos.", "El método falla sin datos limpios.", "Le modèle ne nécessite aucune annotation.", "Il n'y a pas de différence entre les deux méthodes.", "La méthode échoue sans données propres.",
]


def said(s):
    return declines(s, re.findall(r"[^\W_]+", s.lower()))


def test_held_out_refusals():
    missed = [s for s in REFUSALS if not said(s)]
    assert len(missed) <= 0.1 * len(REFUSALS), missed


def test_statements_are_none():
    wrong = [s for s in STATEMENTS if said(s)]
    assert len(wrong) <= 1, wrong


def test_substance_beside_a_refusal():
    q = "What limits the method?"
    assert judge(q, "I don't know the exact figure. The method fails on long texts and needs clean labels.", False) is None
    assert judge(q, "The sources do not say when, but they report a drop of four points on noisy input.", False) is None
    assert judge(q, "The passages concern map matching only. I found nothing about your question. Please try another source.", False) == "refusal"
    assert judge(q, "The passages concern map matching only. I found nothing about your question. Please try another source.", True) is None


def test_open_bracket_far_back():
    assert judge("What is X?", "X is a method (" + "with many words " * 60 + "and more", False) == "truncated"
