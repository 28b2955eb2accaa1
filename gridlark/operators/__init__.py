"""Panel, graph, learner and reporting operators."""
