"""Scores of transcripts against a walk through their calls."""

import random

from corvane.operators import scoring as S


def walk(calls, facts):
    calls = sorted(calls)
    out = {"calls": len(calls), "retrieves": 0, "errors": 0, "retries": 0, "recovered": 0, "cites": 0}
    met, failed, seen, cited, emitted, clean, sufficient, surplus = set(), set(), {}, set(), set(), 0, None, 0
    for n, tool, target, bad in calls:
        out["errors"] += bad
        if target is not None:
            clean += target not in met and not bad
            out["retries"] += target in failed
            out["recovered"] += target in failed and not bad
        if tool == S.CITE:
            out["cites"] += 1
            emitted.add(target)
            if target in seen:
                cited.add(target)
        if tool == S.RETRIEVE:
            out["retrieves"] += 1
            surplus += sufficient is not None
            if not bad:
                seen.setdefault(target, n)
        if target is not None:
            met.add(target)
            if bad:
                failed.add(target)
        if facts and sufficient is None and facts <= set(seen):
            sufficient = n
    emitted.discard(None)
    out |= {"targets": len(met), "emitted": len(emitted), "covered": len(cited - {None}), "facts": len(facts), "facts_seen": len(facts & set(seen)), "facts_cited": len(facts & cited), "sufficient_at": sufficient, "surplus": surplus if sufficient is not None else None}
    ratio = lambda a, b: round(a / b, 6) if b else None
    out |= {"first_try_rate": ratio(clean, len(met)), "recovery_rate": ratio(out["recovered"], out["retries"]), "error_rate": ratio(out["errors"], len(calls)), "fact_recall": ratio(out["facts_seen"], len(facts)), "cite_recall": ratio(out["facts_cited"], len(facts)), "cite_precision": ratio(out["covered"], max(out["emitted"], out["covered"])), "efficiency": ratio(out["facts_seen"], out["retrieves"])}
    out |= {"refused": any(c[1] == S.REFUSE for c in calls), "answered": calls[-1][1] == S.CITE}
    return out


def test_scores_equal_a_walk(spark):
    rng = random.Random(6)
    calls, facts = [], []
    for t in range(40):
        for n in range(1, rng.randint(2, 15)):
            tool = rng.choice([S.RETRIEVE, S.RETRIEVE, S.CITE, "open", S.REFUSE])
            calls.append((t, n, tool, None if tool == S.REFUSE or rng.random() < 0.05 else rng.randint(1, 4), tool == S.RETRIEVE and rng.random() < 0.3))
        facts += [(t, f) for f in rng.sample(range(1, 5), rng.randint(0, 3))]
    facts += [(900, 1), (0, 4), (0, 4)]
    df = S.score_transcripts(spark.createDataFrame(calls, "transcript long, n int, tool string, target int, failed boolean"), spark.createDataFrame(facts, "transcript long, target int"))
    got = {r["transcript"]: r.asDict() for r in df.collect()}
    assert set(got) == {c[0] for c in calls}
    for t, row in got.items():
        want = walk([c[1:] for c in calls if c[0] == t], {f for u, f in facts if u == t})
        assert {k: row[k] for k in want} == want
    every = S.run_summary(df).first()
    assert every["transcripts"] == len(got)
    known = [r["recovery_rate"] for r in got.values() if r["recovery_rate"] is not None]
    assert abs(every["mean_recovery_rate"] - sum(known) / len(known)) < 1e-5 and len(known) < len(got)
    assert abs(every["pooled_fact_recall"] - sum(r["facts_seen"] for r in got.values()) / sum(r["facts"] for r in got.values())) < 1e-5
    assert {r["refused"] for r in S.run_summary(df, "refused").collect()} == {True, False}
