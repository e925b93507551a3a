"""Relations. Times are local wall-clock seconds (LONG): day arithmetic on them is exact in any zone."""

MESSAGES = "user_id long, id long, ts long, sender string, text string, is_proactive boolean"
EPISODES = "user_id long, id long, date date, summary string, related_date date, resolved boolean, importance string, expires_at long"
HYPOTHESES = "user_id long, id long, statement string, level string, evidence array<date>, contradictions array<date>, last_seen date, sensitive boolean"
CURRENT_STATE = "user_id long, id long, statement string, created_at long, expires_at long"
SEND_LOG = "user_id long, id long, ts long, decision string, reason string, message_type string, message_id long, replied boolean, reply_delay_minutes long, response_length string, conversation_continued boolean"
USER_SETTINGS = "user_id long, active_start string, active_end string, do_not_disturb_until long, preferred_frequency string"
REFLECTIONS = "user_id long, date date, data string, seq long"
FORGOTTEN = "user_id long, id long, text string, created_at long"

#: The decider's answers.
PROACTIVE = "struct<decision:string,reason:string,message_type:string,message:string>"
CHAT = "struct<message:string,memory_command:struct<action:string,target:string,target_ids:array<string>>,do_not_disturb_until:string,preferred_frequency:string>"
REFLECTION = "struct<date:string,important_events:array<struct<summary:string,related_date:string,importance:string>>,resolved_episode_ids:array<bigint>,current_state:array<struct<statement:string,expires_in_days:string>>,hypothesis_updates:array<struct<id:bigint,statement:string,observation:string,sensitive:boolean,user_stated:boolean>>,unresolved_topics:array<string>,conversation_reaction:string>"
REVIEW = "struct<hypothesis_changes:array<struct<id:bigint,action:string,new_statement:string>>,active_hours_suggestion:struct<start:string,end:string>,notes:string>"
#: Kinds of outbound messages, levels and importances in order.
MESSAGE_TYPES = ("follow_up", "observation", "recall", "sharing", "check_in", "playful", "recommendation")
LEVELS = ("mentioned", "repeated", "confirmed")
IMPORTANCES = ("low", "mid", "high")
