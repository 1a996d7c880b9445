from pyspark.sql import functions as F

from brookmill.operators import mails

TABLE = "Name | Title | Skills | Experience | Location | Email\nJohn Doe | Java Developer | Java, Spring | 8 | Dallas, TX | john.doe@example.com\n"
JOB = "Job Title: Senior Java Developer\nRequired Skills: Java, Spring, Microservices, AWS\nLocation: Remote\nWe need a senior Java developer with strong microservices experience for a long-term client engagement.\n"


def read(spark, parser, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [r.m for r in df.select("id", parser(F.col("text")).alias("m")).orderBy("id").collect()]


def test_hotlists(spark):
    blocks = "Hi all,\n\nName: Ann Bee\nTitle: QA Lead\nSQL and Python, 7+ years\nAustin, TX, H1B, $65/hr, immediate\nName: Cy Dee\nRole - .NET Developer\n\nother\n\nConsultant: Eve\nGCP only"
    tabs = "Subject: x\nhello\nConsultant\tVisa\tSkill\nAnn\tGC\t\nBo"
    mixed = f"Name: Zed\nTitle: Analyst\n\n{TABLE}"
    table, block, tab, both, prose, blank, null, bare = read(spark, mails.hotlist, TABLE, blocks, tabs, mixed, "hi there", "  \n ", None, "Name | Title\nno cells below")
    john = table.records[0]
    assert (john.name, john.title, john.skills, john.years, john.location, john.email, john.parse_confidence) == ("John Doe", "Java Developer", ["Java", "Spring"], 8, "Dallas, TX", "john.doe@example.com", 0.92)
    assert (table.record_count, table.confidence, table.requires_review, table.warnings) == (1, 0.92, False, [])
    assert [(r.name, r.title, r.skills, r.years, r.location, r.work_authorization, r.rate, r.availability) for r in block.records] == [
        ("Ann Bee", "QA Lead", ["Python", "SQL"], 7, "Austin, TX", "H1B", "$65/hr", "Immediate"),
        ("Cy Dee", ".NET Developer", [], None, None, None, None, None),
        ("Eve", None, ["GCP"], None, None, None, None, None),  # a cloud's name is no green card
    ]
    assert [(r.name, r.work_authorization, r.source, r.warnings) for r in tab.records] == [("Ann", "GC", 3, ["candidate_title_or_skills_missing"])]
    assert (tab.confidence, tab.warnings) == (0.62, ["one_or_more_consultants_require_review"])
    assert [r.name for r in both.records] == ["John Doe"]  # a table counts before blocks
    assert (prose.record_count, prose.confidence) == (1, 0.30)
    assert all((m.record_count, m.confidence, m.requires_review, m.warnings) == (0, 0.0, True, ["no_consultants_detected"]) for m in (blank, null))
    assert bare.record_count == 1  # a header without rows is no table


def test_requirements(spark):
    several = "Subject: Fwd: Hiring: Data Engineer | TX\nFrom: a\nTo: b\n\nPosition: 1\nTitle: Java Developer\nClient: Acme, Inc.\nRequired Skills: Java; SQL\n\nTitle: QA Tester\nLocation: Austin, TX\nneeds sql and more than forty characters here\nThanks,\nAnn\nTitle: Senior Recruiter"
    numbers = "We have\n1) Java Developer\nClient: Zed\n2) QA Analyst\nremote with python and so on and so forth\n12) call us"
    duties = "Role Descriptions: Yardi\n1) Java Developer\n2) QA Analyst"
    again = "Job Title :\n\nData Architect\nEmployer: Q Co\nJob Title: data  ARCHITECT\n5 years python sql contract rate $60/hr ok"
    one, two, three, four, five, subject, null = read(spark, mails.requirement, JOB, several, numbers, duties, again, "Subject: Re: Hiring: Data Engineer | TX\nplease send someone", None)
    assert [(r.job_title, r.skills, r.location, r.parse_confidence, r.warnings) for r in one.records] == [("Senior Java Developer", ["Java", "Spring", "Microservices", "AWS"], "Remote", 0.65, ["company_missing"])]
    assert [(r.job_title, r.company, r.location, r.skills, r.parse_confidence) for r in two.records] == [("Java Developer", "Acme, Inc", "Austin, TX", ["Java", "SQL"], 0.92), ("QA Tester", "Acme, Inc", "Austin, TX", ["SQL"], 0.92)]
    assert "Recruiter" not in two.records[1].job_description
    assert [(r.job_title, r.company, r.location) for r in three.records] == [("Java Developer", "Zed", "Remote"), ("QA Analyst", "Zed", "Remote")]
    assert four.record_count == 1 and (five.record_count, five.records[0].job_title, five.records[0].rate) == (1, "Data Architect", "$60/hr")
    assert subject.records[0].job_title == "Data Engineer"
    assert (null.record_count, null.requires_review, null.warnings) == (0, True, ["no_requirements_detected"])


def test_dispatch_and_kind(spark):
    whole = JOB + "Company: Acme\n"
    assert [r for r in read(spark, mails.likely_kind, TABLE, JOB, whole, "nothing of the kind", None)] == ["hotlist", "unknown", "job_description", "unknown", "unknown"]
    hot, = read(spark, lambda t: mails.business_records(t, F.lit("hotlist")), TABLE)
    job, = read(spark, lambda t: mails.business_records(t, F.lit("job_description")), whole)
    none, = read(spark, lambda t: mails.business_records(t, F.lit(None).cast("string")), TABLE)
    assert (len(hot.consultants), hot.positions, len(job.positions), job.consultants) == (1, [], 1, [])
    assert (none.record_count, none.requires_review, none.warnings) == (0, True, ["unsupported_email_document_kind"])


def test_long_mails(spark):
    many = "Name | Title\n" + "\n".join(f"P{i} | Developer" for i in range(3000))
    labels = "\n".join(f"Name: P{i}\nTitle: Developer" for i in range(2000))
    spaces = "Name" + " " * 50_000 + "x" + "\n" * 20_000 + "y"
    sizes = [m.record_count for m in read(spark, mails.hotlist, many, labels, spaces, "a" * 200_000)]
    assert sizes == [3000, 2000, 1, 1]
    assert [m.record_count for m in read(spark, mails.requirement, spaces, "a" * 200_000, "\n".join(f"Title: Developer {i}" for i in range(2000)))] == [1, 1, 2000]
