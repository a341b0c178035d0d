"""Extensions: the same operators on unbounded input. The batch surface does not need them."""
