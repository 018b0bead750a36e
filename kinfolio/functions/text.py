"""Rendering, truncation and length features of conversations and responses."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import is_odd, stable_rank

#: Where length bins end.
LENGTH_BINS = ((1000, "le1000"), (3000, "le3000"), (8000, "le8000"))


def length_features(first: Column, second: Column) -> Column:
    """log(1 + code points) of two normalised texts."""
    return F.array(F.log1p(F.length(first).cast("double")), F.log1p(F.length(second).cast("double")))


def length_bin(length: Column) -> Column:
    out = F.lit("gt8000")
    for most, name in reversed(LENGTH_BINS):
        out = F.when(length <= most, name).otherwise(out)
    return out


def match_stratum(domain: Column, length: Column) -> Column:
    return F.concat_ws("|", domain, length_bin(length))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def role_sections(messages: Column, response: Column) -> Column:
    """Messages (role, content) and the response, each under its role in brackets."""
    said = F.transform(messages, lambda m: F.concat(F.lit("["), F.upper(F.trim(F.coalesce(m["role"], F.lit("user")))), F.lit("]\n"), F.trim(F.coalesce(m["content"], F.lit("")))))
    return F.concat(F.array_join(said, "\n"), F.lit("\n[ASSISTANT RESPONSE]\n"), response)


def context_text(messages: Column) -> Column:
    """Messages as one line each: [ROLE r] and the content."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("[ROLE "), F.upper(F.coalesce(m["role"], F.lit("unknown"))), F.lit("] "), F.coalesce(m["content"], F.lit("")))), "\n")


def head_tail(tokens: Column, budget: int, marker: Sequence[int], least: int = 2) -> Column:
    """Tokens within ``budget``: all, or head, marker and tail, the head with the
    odd one more; a budget below the marker and ``least`` tokens keeps the head alone."""
    free = budget - len(marker)
    n = F.size(tokens)
    if free < least:
        return F.slice(tokens, 1, budget)
    head, tail = (free + 1) // 2, free // 2
    cut = F.concat(F.slice(tokens, 1, head), F.array(*map(F.lit, marker)), F.slice(tokens, n - tail + 1, tail))
    return F.when(n <= budget, tokens).otherwise(cut)


def serialize_candidate(context: Sequence[int], response: Sequence[int], *, most: int, context_share: float, marker: Sequence[int]) -> list[int]:
    """Context and response within ``most`` tokens: the context's tail, and the
    response's head and tail. What one doesn't need the other gets."""
    context, response, marker = list(context), list(response), list(marker)
    if len(context) + len(response) <= most:
        return context + response
    for_context = min(len(context), int(most * context_share))
    for_response = min(len(response), most - for_context)
    for_context = min(len(context), most - for_response)
    free = for_response - len(marker)
    if len(response) > for_response:
        response = response[: (free + 1) // 2] + marker + response[len(response) - free // 2 :] if free >= 2 else response[:for_response]
    return context[len(context) - for_context :] + response


#: Least tokens of each part, and who gets what is left over.
PART_LEAST = {"context": 64, "original": 80, "feedback": 144, "candidate": 160}
SPARE_ORDER = ("candidate", "feedback", "original", "context")


def part_budgets(lengths: dict[str, int], total: int) -> dict[str, int]:
    """Budgets of the parts of a serialised candidate: least ones first, what is
    left to those that need more, in SPARE_ORDER."""
    out = {k: min(lengths.get(k, 0), v) for k, v in PART_LEAST.items()}
    left = total - sum(out.values())
    for k in SPARE_ORDER:
        more = max(0, min(left, lengths.get(k, 0) - out[k]))
        out[k] += more
        left -= more
    return out


def shared_quota(lengths: Sequence[int], total: int) -> list[int]:
    """Water-filling: entries get equal shares, what short ones leave goes to the others, odd tokens to the first."""
    out, open_, left = [0] * len(lengths), [i for i, n in enumerate(lengths) if n > 0], total
    while open_ and left > 0:
        share, extra = divmod(left, len(open_))
        done = [i for i in open_ if lengths[i] - out[i] <= share]
        if not done:
            for j, i in enumerate(open_):
                out[i] += share + (j < extra)
            return out
        for i in done:
            left -= lengths[i] - out[i]
            out[i] = lengths[i]
        open_ = [i for i in open_ if out[i] < lengths[i]]
    return out


#: What stands before each part, and for tokens that are left out.
PART_MARKERS = {"context": "[CONTEXT]", "original": "[ORIGINAL_RESPONSE]", "feedback": "[FEEDBACK]", "candidate": "[CANDIDATE_EDIT]"}
OMITTED = "[...OMITTED...]"


def without_middle(tokens: Sequence[int], budget: int, marker: Sequence[int]) -> list[int]:
    """Tokens within ``budget``: head, marker and tail, the head with the odd one more;
    the head alone where the marker would leave one token or none."""
    free = budget - len(marker)
    if len(tokens) <= budget:
        return list(tokens)
    if free <= 1:
        return list(tokens[: max(0, budget)])
    return [*tokens[: (free + 1) // 2], *marker, *(tokens[-(free // 2) :] if free // 2 else ())]


def joined_entries(headers: Sequence[Sequence[int]], contents: Sequence[Sequence[int]], budget: int, marker: Sequence[int]) -> list[int]:
    """Every entry under its header, within ``budget``: one token each at least, what
    is left shared out by ``shared_quota``. Raises if an entry is empty or can't be held."""
    if not all(contents):
        raise ValueError("an entry is empty")
    left = budget - sum(map(len, headers)) - len(contents)
    if left < 0:
        raise ValueError(f"{budget} tokens can't hold {len(contents)} entries")
    more = shared_quota([len(c) - 1 for c in contents], left)
    return [t for h, c, n in zip(headers, contents, more, strict=True) for t in (*h, *without_middle(c, n + 1, marker))]


def serialize_construct(encode: Callable[[str], Sequence[int]], context: str, original: str, feedback: Sequence[str], candidate: str, *, most: int = 512, start: Sequence[int] = (), end: Sequence[int] = ()) -> list[int]:
    """The parts of a candidate, each behind its marker, in ``most`` tokens with what
    opens and closes a sequence. Each part keeps some tokens; one that is empty raises."""
    markers, marker = {k: encode(v) for k, v in PART_MARKERS.items()}, encode(OMITTED)
    headers, contents = [encode(f"[ENTRY {i}/{len(feedback)}]") for i in range(1, len(feedback) + 1)], [encode(f.strip()) for f in feedback]
    parts = {"context": encode(context), "original": encode(original.strip()), "feedback": [t for h, c in zip(headers, contents, strict=True) for t in (*h, *c)], "candidate": encode(candidate.strip())}
    if empty := [k for k, v in parts.items() if not len(v)]:
        raise ValueError(f"empty parts: {', '.join(empty)}")
    room = most - sum(map(len, markers.values())) - len(start) - len(end)
    if room < sum(PART_LEAST.values()):
        raise ValueError(f"{most} tokens are too few for the parts' least budgets")
    budgets = part_budgets({k: len(v) for k, v in parts.items()}, room)
    held = {k: without_middle(v, budgets[k], marker) for k, v in parts.items() if k != "feedback"} | {"feedback": joined_entries(headers, contents, budgets["feedback"], marker)}
    return [*start, *(t for k in PART_MARKERS for t in (*markers[k], *held[k])), *end]


def token_lengths(tokenize: Callable[[str], Sequence[int]], context: str, response: str, *, end: bool = True) -> tuple[int, int, int]:
    """Tokens of context, response and both, with one more if an end token is added."""
    a, b = len(tokenize(context)), len(tokenize(response))
    return a, b, a + b + int(end)


def preferred(preference: Column, first: Column, second: Column) -> Column:
    """The preferred response; a preference of 0 raises."""
    return F.when(preference > 0, second).when(preference < 0, first).otherwise(F.raise_error(F.lit("a tie has no preferred response")))


def orient(identifier: Column, better: Column, worse: Column) -> Column:
    """(response1, response2, overall_preference) with sides dealt by a hash."""
    swap = is_odd(stable_rank(0, "pair_orientation", identifier), 16)
    return F.struct(F.when(swap, worse).otherwise(better).alias("response1"), F.when(swap, better).otherwise(worse).alias("response2"), F.when(swap, 1).otherwise(-1).alias("overall_preference"))
