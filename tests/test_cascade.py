"""The provider cascade against a plain sequential version."""

import hashlib

import pytest

from quarrystone.sources import cascade, providers, store


class Recorded(providers.Seeded):
    """Breaks on whole calls where the first prompt says so."""

    def timed(self, prompts):
        if any("break " + self.name in p for p in prompts):
            raise ConnectionError(self.name)
        return super().timed(prompts)


def plain(prompts, made, batches, slow_after, most_strikes, cooldown):
    """Answers and calls by provider, one prompt after another."""
    names, fakes = [n for n, _ in made], dict(made)
    strikes, rest, answers, calls = dict.fromkeys(names, 0), {}, {}, {n: [0, 0, 0] for n in names}
    orders = []
    for k in range(batches):
        order = [n for n in names if n not in rest] + sorted((n for n in names if n in rest), key=lambda n: (rest[n], names.index(n)))
        orders.append(order)
        bad = dict.fromkeys(names, 0)
        for p in sorted(set(prompts)):
            if p in answers or int(hashlib.md5(p.encode()).hexdigest()[:8], 16) % batches != k:
                continue
            for n in order:
                a, s = fakes[n].timed([p])[0]
                calls[n][0] += 1
                calls[n][1] += a is None
                calls[n][2] += s > slow_after
                bad[n] += a is None or s > slow_after
                if a is not None:
                    answers[p] = a
                    break
        rest = {n: r - 1 for n, r in rest.items() if r > 1}
        for n in names:
            strikes[n] += bad[n]
            if strikes[n] >= most_strikes:
                strikes[n], rest[n] = 0, cooldown
    return answers, calls, orders


@pytest.mark.parametrize("most_strikes, cooldown, batches", [(2, 1, 6), (40, 2, 8), (10_000, 1, 3)])
def test_equals_a_sequential_version(spark, tmp_path, most_strikes, cooldown, batches):
    made = [("a", providers.Seeded("a", 80, 60)), ("b", providers.Seeded("b", 30, 10)), ("c", providers.Seeded("c", 120))]
    prompts = [f"prompt {k % 300}" for k in range(500)] + ["É", "", None]
    rows = spark.createDataFrame([(k, p, "x") for k, p in enumerate(prompts)], "id long, prompt string, provider string").repartition(3)
    asked = cascade.Cascade(made, store.Store(spark, str(tmp_path)), 50.0, most_strikes, cooldown, batches)
    got = {r["id"]: r["answer"] for r in asked.apply(rows).collect()}
    answers, calls, orders = plain([p for p in prompts if p is not None], made, batches, 50.0, most_strikes, cooldown)
    assert got == {k: answers.get(p) for k, p in enumerate(prompts)}
    assert {r["provider"]: [r["calls"], r["failures"], r["slow"]] for r in asked.calls().collect()} == {n: c for n, c in calls.items() if c[0]}
    if most_strikes < 10_000:
        assert len({tuple(o) for o in orders}) > 1


def test_each_prompt_is_asked_once_over_runs(spark, tmp_path):
    rows = spark.createDataFrame([(f"p{k % 20}",) for k in range(100)], "prompt string")
    first = cascade.Cascade([("a", providers.Seeded("a"))], store.Store(spark, str(tmp_path)), batches=2)
    first.apply(rows)
    assert first.calls().first()["calls"] == 20
    again = cascade.Cascade([("a", providers.Seeded("a"))], store.Store(spark, str(tmp_path)), batches=2)
    assert again.apply(rows).filter("answer IS NOT NULL").count() == 100 and again.calls().count() == 0


def test_a_provider_that_breaks_is_passed_over(spark, tmp_path):
    rows = spark.createDataFrame([("break a",), ("fine",)], "prompt string").coalesce(1)
    asked = cascade.Cascade([("a", Recorded("a")), ("b", Recorded("b"))], store.Store(spark, str(tmp_path)), batches=1)
    assert asked.apply(rows).filter("answer IS NULL").count() == 0
    assert asked.health.order() == ["b", "a"]
    assert {r["provider"]: r["failures"] for r in asked.calls().collect()}["b"] == 0


def test_shorter_contexts(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x" * 50), (2, "y" * 5), (3, None), (4, "z" * 500), (4, "z" * 500)], "id long, text string")
    asked = cascade.Cascade([("a", providers.Seeded("a", most=40))], store.Store(spark, str(tmp_path)), batches=2)
    got = cascade.with_answers(rows, asked, lambda c: c, "text", (100, 30, 10)).collect()
    assert sorted((r["id"], r["attempt"]) for r in got) == [(1, 3), (2, 1), (3, 1), (4, 3), (4, 3)]
    none = cascade.Cascade([("d", providers.Disabled())], store.Store(spark, str(tmp_path / "d")), batches=2)
    assert [(r["answer"], r["attempt"]) for r in cascade.with_answers(rows, none, lambda c: c, "text", (9,)).collect()] == [(None, None)] * 5


class Few(providers.Seeded):
    """Takes few prompts at once."""

    def timed(self, prompts):
        if len(prompts) > 256:
            raise ValueError("too many")
        return super().timed(prompts)


def test_calls_are_bounded(spark, tmp_path):
    asked = cascade.Cascade([("a", Few("a"))], store.Store(spark, str(tmp_path)), batches=1)
    rows = spark.range(3000).selectExpr("id", "concat('p', id) AS prompt").coalesce(1)
    assert asked.apply(rows).filter("answer IS NULL").count() == 0
