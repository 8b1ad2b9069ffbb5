"""Queries written in SQL only, with the library's functions."""
from siftwork.config import DEFAULT as S
from siftwork.functions import fixed_values as fv, sql
from siftwork.plans import oracle as o
from siftwork.plans.q_score import COMPOSITE_SQL, RUBRIC_SQL
from siftwork.plans.registry import query
from siftwork.sources.views import view


def _views(spark, d, **columns):
    sql.register(spark, S)
    for name, some in columns.items():
        view(spark, d, name, some).createOrReplaceTempView(f"sql_{name}")


@query("q01_sql_rubric", f"SELECT eval_seq, lik, des, {RUBRIC_SQL} AS bucket FROM ({COMPOSITE_SQL})")
def q01(spark, d):
    """Composite scores and buckets by SQL functions."""
    _views(spark, d, evals=None, postings=["company_id"], company_dim=None)
    return spark.sql("""WITH r AS (SELECT e.*, coalesce(c.reputation, CASE c.tier WHEN 1 THEN 90 WHEN 2 THEN 70 WHEN 3 THEN 55 END, 50) AS rep
 FROM sql_evals e JOIN sql_postings p ON p.job_id = e.job_id LEFT JOIN sql_company_dim c ON c.company_id = p.company_id),
s AS (SELECT eval_seq, interest, wildcard, likelihood(skills_match, level_match) AS lik, desirability(work_alignment, experience_quality, rep) AS des FROM r)
SELECT eval_seq, lik, des, rubric_bucket(lik, des, interest, wildcard) AS bucket FROM s""")


@query("q02_sql_terms", f"""SELECT term, count(*) AS postings FROM (SELECT unnest(string_split(terms_txt, '|')) AS term FROM postings WHERE terms_txt <> '' AND {o.rm('title', '(?i)' + chr(92) + 'b(?:' + '|'.join(fv.INTERNSHIP_WORDS) + ')' + chr(92) + 'b')}) GROUP BY 1""")
def q02(spark, d):
    """Internships per term: a scalar and a table function."""
    _views(spark, d, postings=["title", "terms_txt"])
    return spark.sql("SELECT t.item AS term, count(*) AS postings FROM sql_postings p, LATERAL split_list(p.terms_txt) t WHERE is_internship(p.title) GROUP BY t.item")
