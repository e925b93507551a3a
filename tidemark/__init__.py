"""tidemark: conversation-log analytics and temporal memory rules on Spark."""
