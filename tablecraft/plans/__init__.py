"""The three workloads: retail report, churn model, recommendations."""
