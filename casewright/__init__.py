"""Investigation analytics on Spark: payment review, structuring, policy
retrieval and incident correlation as DataFrame-to-DataFrame operators."""
