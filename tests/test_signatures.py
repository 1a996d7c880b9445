"""Signatures of mails, case by case."""

import pytest
from pyspark.sql import functions as F

from brookmill.operators import signatures

LEGAL = "This email and any attachments are confidential and may be privileged. If you are not the intended recipient, please delete this message."
# name: (text, sender, whole history, expected values by path)
CASES = {
    "plain": ("Hi team,\n\nPlease see the list.\n\nBest regards,\nJohn Smith\nSenior Technical Recruiter\nABC Staffing Inc\njohn@abcstaffing.com\nP: (214) 555-1234\n", None, False,
              {"detected": True, "method": "signoff_marker", "contact.name.value": "John Smith", "contact.title.value": "Senior Technical Recruiter", "contact.company.value": "ABC Staffing Inc", "contact.email.value": "john@abcstaffing.com", "contact.phone.value": "+12145551234", "contact.last_name": "Smith", "confidence": 0.92, "requires_review": False, "warnings": []}),
    "markup": ("Thanks,<br>\nPriya Menon<br>\nIT Recruiter | Global Tech Solutions LLC<br>\npriya.menon@globaltech.com&nbsp;\n", None, False, {"detected": True, "method": "structural", "contact.email.value": "priya.menon@globaltech.com", "contact.title.value": "IT Recruiter", "contact.company.value": "Global Tech Solutions LLC<br>"}),
    "broken markup": ('Regards,\n<div><span>Alex <b>Rivera</b\n<img src=cid:image001.png@01D12345 alt="logo">\nTalent Partner\n', None, False, {"detected": True, "contact.email": None, "contact.phone": None, "contact.mobile": None}),
    "logo": ("Best,\nDana Lee\n[Company Logo]\nRecruiter\ndana.lee@example.com\n", None, False, {"contact.name.value": "Dana Lee", "contact.title.value": "Recruiter", "contact.company": None}),
    "recruiter": ("Regards,\nMichael Chen\nTechnical Recruiter\nPeak Consulting Group\nmichael.chen@peakconsulting.com\nM: 469-555-7890\n", None, False, {"contact.title.value": "Technical Recruiter", "contact.mobile.value": "+14695557890", "contact.phone": None}),
    "consultant": ("Thank you,\nSara Ahmed\nSenior Consultant\nsara.ahmed@example.com\n", None, False, {"contact.name.value": "Sara Ahmed", "contact.title.value": "Senior Consultant"}),
    "staffing company": ("Best,\nRobert Diaz\nAccount Manager\nPrime Staffing Solutions Inc\nrobert.diaz@primestaffing.com\n", None, False, {"contact.title.value": "Account Manager", "contact.company.value": "Prime Staffing Solutions Inc", "contact.company.confidence": 0.75}),
    "dashes": ("Sounds good, let's connect tomorrow.\n\n--\nEmily Zhao\nRecruiter, Client Engagement\nemily.zhao@gmail.com\n", None, False, {"method": "signoff_marker", "contact.email.value": "emily.zhao@gmail.com", "contact.title.value": "Recruiter, Client Engagement"}),
    "disclaimer": ("Sincerely,\nTom Walsh\nDirector of Recruiting\nWalsh Partners LLC\ntom.walsh@walshpartners.com\nO: 972-555-2200\n\n" + LEGAL + "\n", None, False, {"warnings": ["disclaimer_removed"], "contact.phone.value": "+19725552200", "raw": "Sincerely,\nTom Walsh\nDirector of Recruiting\nWalsh Partners LLC\ntom.walsh@walshpartners.com\nO: 972-555-2200"}),
    "extension": ("Best,\nCarla Nguyen\ncarla.nguyen@example.com\nPhone: (214) 555-9000 ext. 204\n", None, False, {"contact.phone.value": "+12145559000", "contact.phone.extension": "204", "contact.phone.confidence": 0.97}),
    "two numbers": ("Best,\nDerek Osei\nderek.osei@example.com\nO: 214-555-1111\nM: 469-555-2222\n", None, False, {"contact.phone.value": "+12145551111", "contact.mobile.value": "+14695552222"}),
    "two numbers without labels": ("Best,\nDerek Osei\n214-555-1111 / 469-555-2222\n", None, False, {"contact.phone.value": "+12145551111", "contact.mobile.value": "+14695552222", "contact.phone.confidence": 0.9}),
    "abroad": ("Regards,\nNina Patel\nnina.patel@example.com\nPhone: +44 20 7946 0958\n", None, False, {"contact.phone.value": "+442079460958"}),
    "fax": ("Best,\nOwen Grant\nowen.grant@example.com\nFax: 214-555-3333\n", None, False, {"contact.phone": None, "contact.mobile": None}),
    "profile": ("Best,\nJohn Smith\nlinkedin.com/in/johnsmith\n", None, False, {"contact.linkedin.value": "https://linkedin.com/in/johnsmith"}),
    "website": ("Best,\nJohn Smith\nABC Staffing Inc\nwww.abcstaffing.com\n", None, False, {"contact.website.value": "https://www.abcstaffing.com"}),
    "tracking link": ("Best,\nJohn Smith\nlinkedin.com/in/johnsmith\nhttps://click.mailchi.mp/track/abc123\n", None, False, {"contact.website": None}),
    "website of the sender": ("Best,\nJohn Smith\n", "J@Acme.io", False, {"contact.website.value": "https://acme.io", "contact.website.confidence": 0.6, "sender_email": "j@acme.io"}),
    "no website of a shared domain": ("Best,\nJohn Smith\n", "j@gmail.com", False, {"contact.website": None}),
    "address": ("Best,\nJohn Smith\nDallas, TX 75201\n", None, False, {"contact.location.city": "Dallas", "contact.location.state": "TX", "contact.location.postal_code": "75201"}),
    "state by name": ("Best,\nJohn Smith\nCharleston, West Virginia\n", None, False, {"contact.location.city": "Charleston", "contact.location.state": "WV", "contact.location.confidence": 0.75}),
    "none": ("Hey, can you send me the update by end of day? Thanks in advance for the quick turnaround on this one.", None, False, {"detected": False, "contact.name": None, "confidence": 0.0, "requires_review": True, "warnings": ["signature_not_detected"], "raw": ""}),
    "short": ("Sounds good.\n\nBest,\nJohn\n", None, False, {"detected": True, "confidence": 0.0}),
    "notice alone": ("Confidentiality Notice: This email and any files transmitted with it are confidential and intended solely for the use of the individual to whom they are addressed.\n", None, False, {"detected": False, "contact.email": None}),
    "long notice": ("Thanks,\nBill Ortiz\nbill.ortiz@example.com\n\nCONFIDENTIALITY NOTICE\nThis message and any attachments are intended solely for the addressee.\n", None, False, {"raw": "Thanks,\nBill Ortiz\nbill.ortiz@example.com", "contact.email.value": "bill.ortiz@example.com"}),
    "device": ("Yes that works for me.\n\nSent from my iPhone\n", None, False, {"method": "mobile_signature_marker", "confidence": 0.0, "contact.name": None}),
    "other address": ("Best,\nJohn Smith\njohn.personal@gmail.com\n", "john.smith@abcstaffing.com", False, {"sender_email": "john.smith@abcstaffing.com", "signature_email": "john.personal@gmail.com"}),
    "forwarded": ("Best,\nAlice Kim\nalice.kim@example.com\n\n---------- Forwarded message ---------\nFrom: Bob Lee <bob.lee@other.com>\nDate: Mon, Aug 24, 2026\nSubject: Fwd: Requirement\n\nRegards,\nBob Lee\nbob.lee@other.com\n", None, False, {"contact.email.value": "alice.kim@example.com", "quoted_ignored": True}),
    "replied": ("Sounds great, thanks!\n\nBest,\nCarol Diaz\ncarol.diaz@example.com\n\nOn Mon, Aug 24, 2026 at 9:00 AM, Dave Park <dave.park@x.com> wrote:\n> Best,\n> Dave Park\n> dave.park@x.com\n", None, False, {"contact.email.value": "carol.diaz@example.com", "quoted_ignored": True}),
    "nested": ("Best,\nGrace Lin\ngrace.lin@example.com\n\nOn Fri, Aug 21, 2026, Henry Osei <henry.osei@y.com> wrote:\n> Regards,\n> Henry Osei\n>\n> On Thu, Ivy Chen <ivy.chen@z.com> wrote:\n> > Thanks,\n> > Ivy Chen\n", None, False, {"contact.email.value": "grace.lin@example.com", "quoted_ignored": True}),
    "history left out": ("No signature here.\n\nOn Mon wrote:\n> Best,\n> Jamie Fox\n> jamie.fox@example.com\n", None, False, {"detected": False, "quoted_ignored": True}),
    "history looked through": ("No signature here.\n\nOn Mon wrote:\n> Best,\n> Jamie Fox\n> jamie.fox@example.com\n", None, True, {"detected": True, "contact.email.value": "jamie.fox@example.com", "quoted_ignored": False}),
    "nothing but a forward": ("FW: role\nFrom: Bob Lee <bob@other.com>\nSent: Monday\nTo: all\nSubject: role\n\nBob Lee, Other Systems LLC\nbob@other.com\nWe need someone.\n" + "More text.\n" * 30, None, False, {"method": "structural", "contact.email.value": "bob@other.com", "contact.company.value": "Bob Lee, Other Systems LLC"}),
    "relay": ("Role offered\nFrom :\nDildaar,\nalltechconsultinginc\ndsingh@alltechconsultinginc.com\nReply to: x\n\nSign-Up for your account\n", None, False, {"method": "relay_from_block", "contact.name.value": "Dildaar", "contact.company.value": "alltechconsultinginc", "contact.email.value": "dsingh@alltechconsultinginc.com", "contact.title": None}),
    "line ends": ("Best,\r\nJohn Smith\r\njohn@example.com\r\n", None, False, {"contact.name.value": "John Smith", "confidence": 0.70}),
    "null": (None, None, False, {"detected": False, "contact.name": None}),
    "empty": ("", None, False, {"detected": False}),
    "long run": ("x" * 200_000, None, False, {"detected": False}),
}


@pytest.fixture(scope="module")
def made(spark):
    rows = [(name, text, sender, quoted) for name, (text, sender, quoted, _) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, text string, sender string, quoted boolean")
    both = [signatures.signatures(df.where(F.col("quoted") == q), "text", "sender", quoted=q) for q in (False, True)]
    return {r.name: r.signature for r in both[0].unionByName(both[1]).collect()}


@pytest.mark.parametrize("name", CASES)
def test_signature(made, name):
    for path, expected in CASES[name][3].items():
        got = made[name]
        for step in path.split("."):
            got = got[step]
        assert got == expected, path


def test_no_rows(spark):
    assert signatures.signatures(spark.createDataFrame([], "text string, span int"), "text").count() == 0
