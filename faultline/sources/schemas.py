"""Schemas of the source payloads (fixed formats)."""

META = ("platform string, pipeline string, failedStage string, parameters map<string,string>, "
        "dependencies map<string,string>, environment map<string,string>, baseline string")

DBT_RUN_RESULTS = (
    "metadata struct<invocation_id:string,generated_at:string>, "
    "results array<struct<status:string,unique_id:string,message:string,failures:int>>")
DBT_MANIFEST = (
    "nodes map<string,struct<path:string,original_file_path:string,resource_type:string>>")

CI_RUN = ("id bigint, name string, head_branch string, head_sha string, status string, "
          "conclusion string, run_started_at string, updated_at string, html_url string, "
          "path string")
CI_JOB = ("id bigint, run_id bigint, name string, conclusion string, "
          "steps array<struct<name:string,conclusion:string,number:int>>")
CI_LOG = "run_id bigint, text string"
COMMIT = ("sha string, commit struct<message:string,author:struct<name:string,date:string>>, "
          "html_url string")

JOB_RUN = ("run_id bigint, job_name string, result_state string, start_time string, "
           "tasks array<struct<key:string,state:string,error:string>>, "
           "cluster struct<spark_version:string,node_type:string>, "
           "libraries map<string,string>, driver_stderr string")

WAREHOUSE_QUERY = ("query_id string, query_text string, execution_status string, "
                   "error_code string, error_message string, warehouse_name string, "
                   "start_time string, total_elapsed_time_ms bigint, rows_produced bigint")
DDL_EVENT = ("id string, object string, statement string, executed_at string, summary string")

STORE_OPERATION = ("operation_id string, db string, collection string, op string, "
                   "duration_ms bigint, plan_summary string, docs_examined bigint, "
                   "docs_returned bigint, error string")

ISSUE = ("key string, project string, title string, status string, labels array<string>, "
         "url string")
