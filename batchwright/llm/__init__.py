"""Operations that a pipeline of training data needs; nothing else in the package imports this one."""
