"""Made-up sessions with known answers: labelled decisions, and transcripts of question sets with their evidence.

Everything follows from a seed. The words of the two splits have nothing in common, so what is tuned on `dev`
is not read off `test`.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np

#: Names of things that sessions are about, by split.
THINGS = {"dev": ("zebra", "walnut", "copper", "lantern", "harbor", "violet", "granite", "maple"), "test": ("otter", "cedar", "silver", "beacon", "canyon", "indigo", "basalt", "willow")}
#: What users and assistants say, by label (None: nothing to be found). {a} and {b} are things.
SAID: dict[tuple[str, str | None], tuple[str, ...]] = {
    ("user", "directive"): ("Never use the {a} library here.", "From now on always run {a} before {b}.", "Use {a} rather than {b}.", "Please don't touch {a}, prefer {b} over it.", "You must not call {a} directly."),
    ("user", None): ("Can you look at {a}?", "As I said, never use {a}.", "The {a} page loads slowly.", "Thanks, {a} works.", "Should we never use {a}?", "The options are {a} or {b}."),
    ("assistant", "reversal"): ("Dropping {a}; let's use {b} instead.", "Change of plan: {b} it is.", "I was wrong about {a}. I'll switch it to {b}.", "Reverting {a} and moving to {b}."),
    ("assistant", None): ("I ran {a} and it passed.", "{a} has three files.", "Here is what {a} does.", "The {a} tests need {b}."),
}


def labelled(seed: int, n: int, split: str = "dev", turns: int = 12, share: float = 0.3) -> Iterator[tuple[str, list[dict]]]:
    """(session id, turns) of n sessions: role, text and decision (null for none) of each turn; users and assistants take turns."""
    things = THINGS[split]
    for k in range(n):
        r = np.random.default_rng([seed, k, sorted(THINGS).index(split)])
        out = []
        for i in range(turns):
            role = ("user", "assistant")[i % 2]
            label = ("directive", "reversal")[i % 2] if r.random() < share else None
            a, b = r.choice(len(things), 2, replace=False)
            forms = SAID[role, label]
            out.append({"role": role, "text": forms[int(r.integers(len(forms)))].format(a=things[a], b=things[b]), "decision": label})
        yield f"{split}-{seed}-{k:04d}", out


def lines(session: str, turns: list[dict], compact_every: int = 0) -> tuple[bytes, list[dict]]:
    """A transcript of turns (role, text, and what else is known of them), and the turns with their byte offsets and ids. After each compact_every turns a boundary marks a compaction."""
    data, placed = b"", []
    for i, t in enumerate(turns):
        if compact_every and i and i % compact_every == 0:
            data += json.dumps({"type": "system", "subtype": "compact_boundary", "sessionId": session, "uuid": f"{session}-cut{i}", "compactMetadata": {"trigger": "auto"}}).encode() + b"\n"
        line = {"type": t["role"], "uuid": f"{session}-{i}", "sessionId": session, "timestamp": f"2026-01-01T{i // 3600 % 24:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z", "message": {"content": [{"type": "text", "text": t["text"]}]}}
        placed.append({**t, "byte_offset": len(data), "uuid": line["uuid"]})
        data += json.dumps(line).encode() + b"\n"
    return data, placed


def transcript(instance: dict, compaction: str = "after_evidence", every: int = 10) -> tuple[bytes, dict]:
    """A question's sessions as one transcript, and its gold: question_id, question, evidence (byte offsets of turns that have the answer), answer_sessions and boundaries.

    compaction: `none`, `every_n` turns, `before_evidence` or `after_evidence` (one boundary, next to the turns that have the answer).
    """
    turns = [{"role": t["role"], "text": t["content"], "has_answer": bool(t.get("has_answer")), "session": s} for s, session in zip(instance["haystack_session_ids"], instance["haystack_sessions"], strict=True) for t in session]
    known = [i for i, t in enumerate(turns) if t["has_answer"]]
    at = {"none": None, "every_n": None, "before_evidence": known[0] if known else None, "after_evidence": known[-1] + 1 if known else None}[compaction]
    data, placed, cuts = b"", [], []
    for i in range(len(turns) + 1):
        if (compaction == "every_n" and i and i % every == 0 and i < len(turns)) or (at is not None and i == at):
            cuts.append(len(data))
            data += json.dumps({"type": "system", "subtype": "compact_boundary", "uuid": f"{instance['question_id']}-cut{i}"}).encode() + b"\n"
        if i < len(turns):
            line = {"type": turns[i]["role"], "uuid": f"{instance['question_id']}-{i}", "sessionId": turns[i]["session"], "message": {"content": turns[i]["text"]}}
            placed.append(len(data))
            data += json.dumps(line).encode() + b"\n"
    return data, {"question_id": instance["question_id"], "question": instance["question"], "evidence": [placed[i] for i in known], "answer_sessions": list(instance["answer_session_ids"]), "boundaries": cuts}


def dump(folder: str, seed: int = 42, n: int = 100, split: str = "dev", compact_every: int = 5) -> int:
    """Writes sessions/<id>.jsonl and gold.json (session, byte offset and kind of each decision); returns the number of decisions. On the driver's disk, as fixtures are."""
    os.makedirs(f"{folder}/sessions", exist_ok=True)
    gold = []
    for session, turns in labelled(seed, n, split):
        data, placed = lines(session, turns, compact_every)
        with open(f"{folder}/sessions/{session}.jsonl", "wb") as f:
            f.write(data)
        gold += [{"session": session, "byte_offset": t["byte_offset"], "kind": t["decision"]} for t in placed if t["decision"]]
    with open(f"{folder}/gold.json", "w") as f:
        json.dump(gold, f, indent=1)
    return len(gold)
