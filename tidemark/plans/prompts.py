"""What models are told, in our own words, and how it gets before the prompts of a plan."""

from __future__ import annotations

from tidemark.plans.providers import Provider

EXAMPLES = "Write three sentences with named entities, in the manner of this text:"
ENTITIES_OF_EXAMPLES = "List the named entities of these sentences as JSON:"
ENTITIES = "List the named entities of this text as JSON:"
QUESTION = "Write one question that fits the template below and a plausible answer, as two lines that begin with 'question:' and 'answer:'."
ANSWER = "Answer the question from the documents alone. Say so if they don't hold the answer. No preamble."
QUALITY = "An answer and its sources follow, parted by '|||'. Reply with 2 if the sources bear out all of it, 1 if most, else 0. Only the number."
CORRECTNESS = "An answer and the true one follow, parted by '|||'. Reply with 2 if they agree, 1 if partly, else 0. Only the number."
FAITHFULNESS = "An answer and its documents follow, parted by '|||'. Reply with 2 if nothing goes beyond the documents, 1 if little does, else 0. Only the number."
REFINE = "Improve this pair."


def instructed(provider: Provider, instruction: str) -> Provider:
    """The provider of a real model, told what to do before each prompt; the plans' own prompts have the data only."""

    def ask(prompts: list[str]) -> list:
        return provider([f"{instruction}\n\n{p}" for p in prompts])

    return ask
