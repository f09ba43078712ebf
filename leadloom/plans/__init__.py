"""End-to-end plans: a lead run, and the analysis of leads."""
