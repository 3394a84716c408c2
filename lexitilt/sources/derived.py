"""Job-posting tables worked out from general document tables.

The same SQL text runs in Spark and in other engines: it is used for the registered
queries and for their checks. ``{...}`` names the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


POSTINGS = """
SELECT doc_id AS job_id,
  CASE WHEN n_chars % 17 = 0 THEN NULL ELSE CAST(substring(source, 4) AS BIGINT) END AS company_id,
  source AS company_name,
  CASE (CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE n_chars END) % 23
    WHEN 0 THEN 'Software Engineer' WHEN 1 THEN 'Senior Software Engineer'
    WHEN 2 THEN 'Junior Developer' WHEN 3 THEN 'Data Scientist'
    WHEN 4 THEN 'Engineering Manager' WHEN 5 THEN 'Director of Engineering'
    WHEN 6 THEN 'Project Manager' WHEN 7 THEN 'Product Manager'
    WHEN 8 THEN 'Mechanical Engineer' WHEN 9 THEN 'Data Entry Clerk'
    WHEN 10 THEN 'Registered Nurse' WHEN 11 THEN 'Principal Data Engineer'
    WHEN 12 THEN 'QA Engineer Intern' WHEN 13 THEN 'Technical Lead'
    WHEN 14 THEN 'VP Engineering' WHEN 15 THEN NULL WHEN 16 THEN 'Cloud Architect'
    WHEN 17 THEN 'Sales Manager' WHEN 18 THEN 'IT Manager'
    WHEN 19 THEN 'Graduate Security Analyst' WHEN 20 THEN 'Lead Engineer'
    WHEN 21 THEN 'C++ / C# .NET Developer' ELSE 'Retail Associate' END AS title,
  CASE WHEN doc_id % 97 = 0 THEN NULL ELSE concat(text,
    CASE n_chars % 8
      WHEN 0 THEN ' He and his team lead the business office. Competitive, driven leader with a career in management.'
      WHEN 1 THEN ' She and her family support the home. Collaborative, kind and supportive, responsible for children.'
      WHEN 2 THEN ' Man and woman, male and female, build cloud services on AWS with Python & SQL. Professional salary.'
      WHEN 3 THEN ' Father, brother and son; mother, sister and daughter. Executive leadership, promotion and risk.'
      WHEN 4 THEN ' Parents, household and marriage support. Interpersonal understanding, connect together.'
      WHEN 5 THEN ' See https://jobs.example.com/a.net for Node.js and React.js roles. Analytical, independent, active.'
      WHEN 6 THEN ' Men and women manage teams, mentor and own projects; strategic planning and budget management.'
      ELSE ' Cross-functional. Domestic relatives, caring. Corporation objective, ambitious and confident.' END,
    ' Req ', CAST(CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE 7 END AS STRING)) END AS description,
  CASE WHEN doc_id % 50 = 1 THEN 'C#, .NET, Kubernetes' ELSE NULL END AS skills_desc,
  CASE doc_id % 7 WHEN 1 THEN 'Internship' WHEN 2 THEN 'Entry level' WHEN 3 THEN 'Associate'
    WHEN 4 THEN 'Mid-Senior level' WHEN 5 THEN 'Director' WHEN 6 THEN 'Executive'
    ELSE NULL END AS formatted_experience_level,
  CASE doc_id % 6 WHEN 0 THEN '0 to 1 Years' WHEN 1 THEN '2 to 5 Years'
    WHEN 2 THEN '5 to 15 Years' WHEN 3 THEN '8 Years' WHEN 4 THEN 'none' ELSE NULL END AS experience,
  CASE doc_id % 5 WHEN 0 THEN 'PhD' WHEN 1 THEN 'M.Tech' WHEN 2 THEN 'MBA' WHEN 3 THEN 'B.Com'
    ELSE NULL END AS qualifications,
  CASE doc_id % 4 WHEN 0 THEN 'Male and female staff, 5 to 10 years, B.Com or MBA; manage teams.'
    WHEN 1 THEN 'Mentor others on cross-functional work. See http://x.example.com/a?b=1 (C++, node.js).'
    WHEN 2 THEN 'Senior expert, both shifts, 3 years.' ELSE NULL END AS responsibilities,
  CASE doc_id % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Both' END AS preference,
  1711317014000 + doc_id * 60000 AS listed_time,
  CASE WHEN doc_id % 100 = 3 THEN 1712345932000 + doc_id * 60000 ELSE NULL END AS closed_time
FROM {documents}
"""

# A posting has an industry by its length, and a second one if it was labelled;
# German postings have only the second, if any. Industry 8 has no name.
JOB_INDUSTRIES = """
SELECT doc_id AS job_id, n_chars % 9 AS industry_id FROM {documents} WHERE lang <> 'de'
UNION ALL
SELECT doc_id AS job_id, (doc_id * 7 + 3) % 9 AS industry_id FROM {labels}
"""

INDUSTRIES = """
SELECT * FROM (VALUES (0,'Software Development'),(1,'IT Services and IT Consulting'),
  (2,'Retail'),(3,'Hospitals and Health Care'),(4,'Technology, Information and Internet'),
  (5,'Financial Services'),(6,'Computer and Network Security'),(7,'Staffing and Recruiting')
) AS t(industry_id, industry_name)
"""

# Sources are numbered from 0, these companies from 2: the first two are unknown.
COMPANIES = "SELECT CAST(n_nationkey AS BIGINT) + 2 AS company_id FROM {nation}"


class Tables:
    """The derived tables of one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def documents(self) -> DataFrame:
        return self.read("documents")

    def postings(self) -> DataFrame:
        return self.spark.sql(POSTINGS, documents=self.documents())

    def job_industries(self) -> DataFrame:
        return self.spark.sql(JOB_INDUSTRIES, documents=self.read("documents"),
                              labels=self.read("labels"))

    def industries(self) -> DataFrame:
        return self.spark.sql(INDUSTRIES)

    def companies(self) -> DataFrame:
        return self.spark.sql(COMPANIES, nation=self.read("nation"))
