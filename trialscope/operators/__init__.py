"""Operators over trials, traces, tools, contracts and review queues."""
