"""Held-out figures of the markup model (problem 2): ``python -m weftgraph.llm.markup_held_out`` prints them."""

from __future__ import annotations

from weftgraph.llm.boosting import BoostedTrees
from weftgraph.llm.markup import SEED, decoded, languages_mask, training_nodes
from weftgraph.llm.markup_nodes import KINDS
from weftgraph.llm.markup_texts import Maker


def folds(n: int) -> list[frozenset[str]]:
    """The kinds of constructs in ``n`` parts, each with some of every language."""
    names = list(Maker(0).made)
    return [frozenset(names[i::n]) for i in range(n)]


def recall_of(trees: BoostedTrees, kind: str, texts: int = 40, seed: int = 977) -> float:
    """Share of the constructs of one kind of which some node is accepted."""
    maker, hits, all_ = Maker(seed), 0, 0
    drawn = [maker.text(only=frozenset((kind,))) for _ in range(texts)]
    for (_, spans), (found, keep) in zip(drawn, decoded(trees, [t for t, _ in drawn])):
        for begin, end, language in spans:
            all_ += 1
            hits += any(found[i].begin < end and max(found[i].end, found[i].begin + 1) > begin and KINDS[found[i].kind][0] == language for i in keep)
    return hits / max(1, all_)


def false_share(trees: BoostedTrees, texts: int = 600, seed: int = 978) -> float:
    """Share of texts without any construct, but with look-alikes, that are said to hold markup."""
    maker = Maker(seed)
    every = frozenset(maker.made)
    return sum(m > 0 for m in languages_mask(trees, [maker.text(skip=every)[0] for _ in range(texts)])) / texts


def held_out(n: int = 6, texts: int = 2400) -> dict[str, float]:
    """Recall of every kind of construct by trees that never saw one of its fold."""
    out = {}
    for fold in folds(n):
        trees = BoostedTrees().fit(*training_nodes(texts, SEED, skip=fold))
        out |= {kind: recall_of(trees, kind) for kind in sorted(fold)}
    return out


if __name__ == "__main__":
    from weftgraph.llm.markup import model

    unseen = held_out()
    print("kind, recall unseen, recall seen")
    for kind, share in sorted(unseen.items(), key=lambda x: x[1]):
        print(f"{kind}, {share:.2f}, {recall_of(model(), kind):.2f}")
    print("texts of look-alikes only said to hold markup:", false_share(model()))
