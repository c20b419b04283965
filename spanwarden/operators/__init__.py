"""DataFrame operators: detection, policy decisions, masking, evaluation."""
