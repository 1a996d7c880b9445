"""The best jobs of resumes, against all pairs."""

import math
import random

import pytest

from brookmill.operators import best, matching, taxonomy

RESUME = "resume_id long, skills array<string>, years_experience double, work_authorization string, location string, class int"
JOB = "job_id long, required_skills array<string>, preferred_skills array<string>, years_experience double, work_authorization string, location string, skills array<string>"
ALIASES = {"Kubernetes": ["K8s"], "PostgreSQL": ["Postgres"], "React": ["ReactJS"], "Spring Boot": ["SpringBoot"]}


@pytest.fixture(scope="module")
def index(spark):
    return taxonomy.alias_index(spark.createDataFrame(list(ALIASES.items()), "canonical string, aliases array<string>")).cache()


def plain(resumes, jobs, k, least):
    """Every pair, one by one."""
    names = {a.lower(): c.lower() for c, others in ALIASES.items() for a in [c, *others]}

    def told(skills):
        out = {}
        for s in skills or []:
            text = " ".join((s or "").lower().replace("-", " ").replace("_", " ").split())
            if text:
                out.setdefault(names.get(text, text), s.strip())
        return out

    rows = []
    for r in resumes:
        held, scored = told(r[1]), []
        for j in jobs:
            required, preferred = told(j[1] if j[1] else j[6]), told(j[2])
            covered = [x for x in required if x in held]
            if not required or not held or len(covered) < math.ceil(len(required) * least / 100 - 1e-9):
                continue
            a = round(100 * len(covered) / len(required), 2)
            b = round(100 * sum(x in held for x in preferred) / len(preferred), 2) if preferred else 0.0
            y = 100.0 if not j[3] or j[3] <= 0 else 50.0 if r[2] is None else 100.0 if r[2] >= j[3] else round(max(0.0, 100 * r[2] / j[3]), 2)
            w = 100.0 if not j[4] or j[4].lower() == "any" else 50.0 if not r[3] else 100.0 if j[4] == r[3] else 0.0
            p = 100.0 if not j[5] else 70.0 if not r[4] else 100.0 if "remote" in (j[5] + r[4]).lower() or j[5] == r[4] else 60.0
            scored.append((-round(a * 0.55 + b * 0.15 + y * 0.15 + w * 0.1 + p * 0.05, 2), j[0], sorted(v for x, v in required.items() if x not in held)))
        rows += [(r[0], n, job, -score, missing) for n, (score, job, missing) in enumerate(sorted(scored)[:k], 1)]
    return sorted(rows)


@pytest.mark.parametrize(("cell", "least", "k"), [(2_000, 60.0, 10), (3, 60.0, 4), (1, 30.0, 3), (7, 100.0, 5)])
def test_equals_all_pairs(spark, index, cell, least, k):
    deal = random.Random(cell)
    skills = ["Java", "K8s", "kubernetes", "Postgres", "PostgreSQL", "react", "ReactJS", "Spring-Boot", "SQL", "Go", "Zorblaxian  framework", " ", None]
    some = lambda most: deal.sample(skills, deal.randint(0, most))
    years, auth, place = [None, 0.0, 3.0, 5.0, 8.0], [None, "gc", "h1b", "Any"], [None, "Dallas", "Remote", "Austin"]
    # Java is everyone's; many rows are alike
    resumes = [(i, (["Java"] if i % 3 else []) + some(5), deal.choice(years), deal.choice(auth[:3]), deal.choice(place[:2]), 1) for i in range(60)]
    resumes += [(100 + i, ["Java", "SQL"], 5.0, "gc", None, 1) for i in range(30)] + [(200, None, None, None, None, 1), (201, [], 1.0, None, None, 1)]
    jobs = [(i, deal.choice([None, some(4), ["Java"] + some(3)]), some(3), deal.choice(years), deal.choice(auth), deal.choice(place), some(2)) for i in range(80)]
    jobs += [(100 + i, ["Java"], None, 3.0, "gc", None, None) for i in range(25)]
    made = best.best_jobs(spark.createDataFrame(resumes, RESUME), spark.createDataFrame(jobs, JOB), index, k=k, least=least, cell=cell)
    got = sorted((r.resume_id, r.rank, r.job_id, r.match_score, sorted(r.missing_required)) for r in made.collect())
    assert got == plain(resumes, jobs, k, least)
    assert got


def test_spellings(spark, index):
    cases = [("K8s", "Kubernetes"), ("Postgres", "PostgreSQL"), ("ReactJS", "React"), ("SpringBoot", "Spring Boot"), ("Kubernetes", "K8s"), ("Zorblaxian Framework", "zorblaxian framework")]
    resumes = spark.createDataFrame([(i, [a], 6.0, "USC", "Dallas, TX", 0) for i, (a, _) in enumerate(cases)], RESUME)
    jobs = spark.createDataFrame([(i, [b, "K8s"] if b == "Kubernetes" else [b], ["Kubernetes"], 5.0, "us citizen", "Dallas, TX", None) for i, (_, b) in enumerate(cases)], JOB)
    rows = {(r.resume_id, r.job_id): r for r in best.best_jobs(resumes, jobs, index).collect()}
    for i, (_, wanted) in enumerate(cases):
        assert rows[i, i].matched_required == [wanted] and rows[i, i].missing_required == [] and rows[i, i].decision == "submit"
    assert rows[0, 0].matched_preferred == ["Kubernetes"] and rows[0, 0].match_score == 100.0
    assert (0, 1) not in rows


def test_no_rows(spark, index):
    resumes, jobs = spark.createDataFrame([], RESUME), spark.createDataFrame([], JOB)
    assert best.best_jobs(resumes, jobs, index).count() == 0


def test_authorizations(spark):
    df = spark.createDataFrame([("H 1B", "h1b", 100.0), ("GC", "Green-Card", 100.0), ("usc", "citizen", 100.0), (None, "gc", 50.0), ("opt", "any", 100.0), ("opt", "gc", 0.0)], "have string, want string, score double")
    rows = df.select("score", matching.authorization_score(df.have, df.want).alias("got")).collect()
    assert [r.got for r in rows] == [r.score for r in rows]


def test_jobs_of_one_set_of_skills_are_not_met_one_by_one(spark, index, monkeypatch):
    sizes, kept = [], best.saved
    monkeypatch.setattr(best, "saved", lambda df: sizes.append((out := kept(df)).count()) or out)
    resumes = [(i, ["Java", "SQL", f"own {i % 20}"], float(i % 5), None, None, 1) for i in range(60)]
    jobs = [(i, ["Java", "SQL"], [f"own {i % 4}"], float(i % 9), None, None, None) for i in range(900)]
    made = best.best_jobs(spark.createDataFrame(resumes, RESUME), spark.createDataFrame(jobs, JOB), index)
    got = sorted((r.resume_id, r.rank, r.job_id, r.match_score, sorted(r.missing_required)) for r in made.collect())
    assert got == plain(resumes, jobs, 10, 60.0)
    assert max(sizes) == 900  # the jobs themselves; all pairs are 54,000
