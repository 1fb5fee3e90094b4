"""The instructions that make a writer cite in the form that protocol.py reads."""

from __future__ import annotations


def citation_instructions(max_cited_claims: int = 15, max_citations_per_claim: int = 2, quote_length: tuple[int, int] = (80, 240), min_quote_length: int = 60) -> str:
    """Text to put before a writing task. `python -m lumenquote.functions.prompt` prints it."""
    low, high = quote_length
    return "\n".join([
        "HOW TO CITE",
        f"1. Budget. Cite at most {max_cited_claims} claims, each with at most {max_citations_per_claim} sources, one if one will do; cite figures, main findings, warnings and definitions that few know, and leave the rest uncited.",
        "2. Source numbers. After a sentence put the number of each source in square brackets, without blanks between: [1][3]. Sources are numbered from 1 in the order given; never invent one, never cite one that does not back the sentence, and write no list of sources.",
        "3. Claim markers. Right after the last number put {c1}, {c2} and so on, counting up, each only once. A sentence or list item with source numbers ends with exactly one marker; no other has one.",
        "4. Appendix. End with a line EVI1, then one line per cited pair of claim and source, then a line END_EVI1. A line reads c1|3|\"the quote\"; inside the quote write \\\" for a quotation mark, \\\\ for a backslash and \\n for a line end. The answer proper ends before EVI1. Nothing follows END_EVI1, and no code fence or other markup stands around the appendix. Without citations there is no appendix.",
        "5. Completeness. Every pair cited in the text has one line in the appendix, and every line is cited in the text. Drop a citation that you have no quote for.",
        f"6. Quotes. Copy them word for word from the source, {low} to {high} characters long, as short as still backs the claim; under {min_quote_length} only if the quote holds a number or is a whole sentence. Change and leave out nothing.",
        "7. Scope. A claim says no more than its quote and speaks of the same thing: keep amounts, conditions and doubts as the source has them, leave undefined terms open, and say always, never or proves only where the quote does.",
    ])


if __name__ == "__main__":
    print(citation_instructions())
