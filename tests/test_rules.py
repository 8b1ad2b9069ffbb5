"""Rule, degree, deadline, cap, role and score behaviour on literal inputs."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwork.config import DEFAULT, RolePick, Settings
from siftwork.functions import caps, dates, degree, roles, rules, scoring, terms

S = DEFAULT


def test_degree_titles_decide(values):
    rows = [("Intern, PhD, Compilers", "phd-only"), ("Intern, MS/PhD, SWE", "master-only"), ("Ph.D. Intern", "phd-only"),
            ("Master's Intern", "master-only"), ("BS/MS Intern", None), ("Undergraduate Intern", None), ("Graph database Intern", None)]
    got = values([(t, "Currently enrolled in a PhD program.") for t, _ in rows[:-1]], "t string, d string",
                 lambda df: degree.degree_mismatch(2, df.t, df.d))
    assert got == [w for _, w in rows[:-1]]


@pytest.mark.parametrize("text, want", [
    ("Currently enrolled in a PhD program.", "phd-only"),
    ("Requirements: enrolled in a PhD or Master's program", "master-only"),
    ("Currently pursuing a BS, MS or PhD in CS.", None),
    ("Currently pursuing a Ph.D. or B.S. in CS.", None),
    ("Preferred qualifications: 1. Currently pursuing a PhD in CS.", None),
    ("Preferred Qualifications - nice. Minimum Qualifications - Currently pursuing a PhD in CS", "phd-only"),
    ("Requirements: PhD preferred.", None), ("Required. Hourly PhD pay $85.", None), ("Our team has PhDs.", None),
    ("Must be a sophomore or in a Masters program", None), ("Must graduate by June 2027.", None), (None, None),
])
def test_degree_descriptions(values, text, want):
    assert values([("SWE Intern", text)], "t string, d string", lambda df: degree.degree_mismatch(2, df.t, df.d)) == [want]


def test_degree_ceiling_and_switch_off(values):
    rows = [("Intern, MS/PhD",)]
    assert values(rows, "t string", lambda df: degree.degree_mismatch(3, df.t, F.lit(None).cast("string"))) == [None]
    assert values(rows, "t string", lambda df: degree.degree_mismatch(0, df.t, F.lit(None).cast("string"))) == [None]
    with pytest.raises(ValueError):
        Settings(degrees=("bachelors",))


def test_unpaid_needs_a_pay_word_nearby(values):
    rows = [("This internship is unpaid.",), ("We offer unpaid time off and pay well.",), ("unpaid " + "z" * 80 + " role",),
            ("no stipend for this role",), ("nothing",)]
    assert values(rows, "s string", lambda df: rules.unpaid_in_context(df.s)) == [True, False, False, True, False]


def test_firmware(values):
    rows = [("Firmware Intern", ""), ("Embedded Intern", "SPI, UART, RTOS"), ("Embedded Intern", "SPI, UART"),
            ("Systems Intern", "SPI UART RTOS JTAG GPIO"), ("Hardware Intern", None)]
    assert values(rows, "t string, d string", lambda df: rules.firmware_heavy(df.t, df.d)) == [True, True, False, False, False]


def test_cascade_order(values):
    rows = [("SWE Intern Fall 2026", "Oslo", "", "", "citizenship is required", "term_mismatch"),
            ("Tax Intern", "Oslo", "", "", "Citizenship is Required", "citizenship"),
            ("Nursing Firmware Intern", "Oslo", "", "", None, "out_of_scope"),
            ("Firmware Intern", "Oslo", "", "", None, "firmware_heavy"), ("SWE Intern", "Oslo", "", "", None, "location_not_allowed"),
            ("SWE Intern", "London", "", "unpaid role", None, "location_excluded"),
            ("SWE Intern", "Austin", "", "unpaid role; top secret", None, "unpaid"),
            ("SWE Intern", "Austin", "", "top secret; must be a U.S. citizen", None, "clearance"),
            ("SWE Intern", "Austin", "", "must be a U.S. citizen. Enrolled in a PhD", None, "citizenship"),
            ("SWE Intern", "Remote", "Winter 2027|Fall 2026", "Enrolled in a PhD", None, "phd-only"),
            ("Autumn 2026 Intern", "", "N/A", "", None, "term_mismatch"), ("2027 Intern", "", "Fall 2026|Spring 2027", None, None, None)]
    got = values([r[:5] for r in rows], "t string, l string, k string, d string, p string", lambda df: rules.first_reason(
        S, title=df.t, location=df.l, terms=terms.split_terms(df.k), text=df.d, sponsorship=df.p))
    assert got == [r[5] for r in rows]


def test_tracks(values):
    rows = [("Intern Summer 2027", "primary"), ("Intern Winter 2027", "alt"), ("Intern 2027", "unknown"), ("Intern", "unknown"),
            ("Spring or Winter 2027", "unknown")]
    got = values([r[:1] for r in rows], "t string", lambda df: terms.term_track(S, df.t, F.array().cast("array<string>")))
    assert got == [r[1] for r in rows]
    assert values([("x",)], "t string", lambda df: terms.term_track(S.but(alt_terms=()), df.t, F.array())) == ["primary"]


def test_deadlines(values):
    now = F.lit("2026-08-29 00:00:00").cast("timestamp_ntz")
    rows = [("Application deadline: October 15, 2026.", "2026-10-15"), ("Please apply by Oct 15th now", "2026-10-15"),
            ("Applications close on 1 November 2026", "2026-11-01"), ("Applications are accepted until 2026-09-30.", "2026-09-30"),
            ("Closing date: 9/12/2026", "2026-09-12"), ("starts January 4, 2027", None), ("Apply before Feb 1.", "2027-02-01"),
            ("apply by June 31, 2026 or 2026-09-01", "2026-09-01"), ("apply by 1/2/2020", None),
            ("apply by 1/2/2020. closing date Sept 3rd", "2026-09-03"), (None, None)]
    got = values([r[:1] for r in rows], "s string", lambda df: dates.deadline(df.s, now).cast("string"))
    assert got == [r[1] for r in rows]


def test_timestamps(values):
    rows = [("2026-10-01",), ("2026-10-01T05:00:00+02:00",), ("2026-10-01 05:00:00",), ("soon",), ("2026-13-01",), (None,)]
    got = values(rows, "s string", lambda df: dates.utc_timestamp(df.s).cast("string"))
    assert got == ["2026-10-01 00:00:00", "2026-10-01 03:00:00", "2026-10-01 05:00:00", None, None, None]


def test_caps(values):
    rows = [("Candidates are limited to three (3) applications within a 30-day period.", 3),
            ("You may submit a maximum of 3 applications per half year.", 3),
            ("apply to up to 4 separate business / location combinations in a year.", 4),
            ("Please only apply for one internship position, choose well.", 1),
            ("We accept one application per season for any programme.", 1), ("You may submit one application per role each year.", None),
            ("Neck: Occasionally (up to 2 minutes in position). Apply.", None), ("open for applications for up to 30 days", None),
            ("First. Submit no more than two applications. Also at most 9 applications.", 2)]
    got = values([r[:1] for r in rows], "s string", lambda df: caps.application_cap(df.s)["cap"])
    assert got == [r[1] for r in rows]
    said = values([("Hi. Candidates  are limited to three (3) applications\nNext",)], "s string", lambda df: caps.application_cap(df.s)["cap_text"])
    assert said == ["Candidates are limited to three (3) applications"]


def test_roles(values):
    rows = [("Quantitative Researcher Intern", "Jane Street", "quantresearch"), ("Linux Intern", "DRW", "quant"), ("Linux Intern", "Signify", "systems"),
            ("GPU Compiler Intern", "x", "gpu"), ("Machine Learning Training Compiler Intern", "x", "ml"), ("Office Intern", "x", "general")]
    got = values([r[:2] for r in rows], "t string, c string", lambda df: roles.classify(S, df.t, df.c))
    assert got == [r[2] for r in rows]
    fall = values([("Intern", "cuda", None), ("Intern", None, "some cuda"), ("Intern", None, "cuda and gpu")], "t string, g string, s string",
                  lambda df: roles.classify(S, df.t, None, df.g, df.s))
    assert fall == ["gpu", "general", "gpu"]
    custom = S.but(role_types=(RolePick("mine", 90, "Mine", ("linux",)),))
    assert values([("Linux Kernel Intern",)], "t string", lambda df: roles.classify(custom, df.t)) == ["systems"]
    assert values([("Linux Intern",)], "t string", lambda df: roles.classify(custom, df.t)) == ["mine"]


def test_local_score(spark):
    rows = [(0, "GPU Software Intern", "a", "cuda python", 90), (1, "Office Intern", "a", None, None), (2, "Tax Intern", "a", None, None),
            (3, "Office Intern", "a", "", None), (4, "GPU hip Internship", "a", "", 55)]
    df = spark.createDataFrame(rows, "n int, title string, company_name string, description_text string, reputation int")
    got = [(r.score, r.band, "|".join(r.why)) for r in scoring.add_local_score(S, df).orderBy("n").collect()]
    assert got[0] == (100, "yes", "gpu|software title|cuda|known company")     # 62+8+14+3+3+12, clamped
    assert got[1] == (36, "ambiguous", "") and got[2] == (6, "no", "off-target: tax") and got[3] == (36, "no", "")
    assert got[4] == (72, "yes", "gpu")                                        # 62+8+1.5 = 71.5, half to even


def test_composite_and_bucket(values):
    got = values([(70, 55, 80, 60, 50)], "a int, b int, c int, d int, r int", lambda df: F.struct(
        scoring.likelihood(S, df.a, df.b), scoring.desirability(S, df.c, df.d, df.r)))
    assert tuple(got[0]) == (65, 66)
    rows = [(65, 50, 0, False, "likely"), (25, 70, 0, False, "reach"), (24, 70, 90, True, "wildcard"), (24, 90, 90, False, "archive")]
    assert values([r[:4] for r in rows], "l int, d int, i int, w boolean", lambda df: scoring.rubric_bucket(S, df.l, df.d, df.i, df.w)) == [
        r[4] for r in rows]
